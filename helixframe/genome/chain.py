"""UCSC chain files: lifting intervals from one assembly to another."""

from __future__ import annotations

import bisect
import gzip
from dataclasses import dataclass, field

from helixframe.sources.files import opened


@dataclass
class Chain:
    score: float
    target: str
    start: int
    end: int
    query: str
    query_size: int
    negative: bool
    query_start: int
    order: int
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # target start, query start, size


@dataclass(frozen=True)
class Lifted:
    contig: str
    start: int  # 0-based
    end: int
    negative: bool


class LiftOver:
    """The chains of a file, loaded once per worker by `LiftOver.of`."""

    _open: dict[str, "LiftOver"] = {}

    def __init__(self, path: str):
        with opened(path) as f:
            data = f.read()
        text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
        self.chains: dict[str, list[Chain]] = {}
        chain, t, q = None, 0, 0
        for n, line in enumerate(text.splitlines()):
            parts = line.split()
            if not parts or line.startswith("#"):
                continue
            if parts[0] == "chain":
                chain = Chain(float(parts[1]), parts[2], int(parts[5]), int(parts[6]), parts[7], int(parts[8]), parts[9] == "-", int(parts[10]), n)
                t, q = chain.start, chain.query_start
                self.chains.setdefault(chain.target, []).append(chain)
            else:
                size = int(parts[0])
                chain.blocks.append((t, q, size))
                if len(parts) == 3:
                    t, q = t + size + int(parts[1]), q + size + int(parts[2])
        for held in self.chains.values():
            held.sort(key=lambda c: c.start)

    @classmethod
    def of(cls, path: str) -> "LiftOver":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def lift(self, contig: str, start: int, end: int, ratio: float = 0.95) -> Lifted | None:
        """The image of [start, end), by the chain that covers most of it, if that is at least the ratio of its length."""
        length = end - start
        if length < 1:
            return None
        best, most = None, 0
        for chain in self.chains.get(contig, []):
            if chain.start >= end:
                break
            if chain.end <= start:
                continue
            first = max(0, bisect.bisect_right(chain.blocks, (start, 1 << 62, 0)) - 1)
            met = []
            for t, q, size in chain.blocks[first:]:
                if t >= end:
                    break
                if t + size > start:
                    lo, hi = max(start, t), min(end, t + size)
                    met.append((q + lo - t, q + hi - t))
            covered = sum(hi - lo for lo, hi in met)
            if covered >= ratio * length and covered > most:
                best, most = (chain, met[0][0], met[-1][1]), covered
        if best is None:
            return None
        chain, lo, hi = best
        if chain.negative:
            lo, hi = chain.query_size - hi, chain.query_size - lo
        return Lifted(chain.query, lo, hi, chain.negative)
