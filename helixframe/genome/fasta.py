"""Indexed FASTA files."""

from __future__ import annotations

from helixframe.sources.files import opened

#: Bytes up to which a file without an index is indexed by reading it.
SMALL = 256 << 20
_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


class Fasta:
    """Sequences of a file with a .fai index beside it; opened once per worker by `Fasta.of`."""

    _open: dict[str, "Fasta"] = {}

    def __init__(self, path: str):
        if path.endswith((".gz", ".bgz")):
            raise ValueError("compressed reference sequences are not supported")
        self.file = opened(path)
        self.index: dict[str, tuple[int, int, int, int]] = {}
        try:
            with opened(path + ".fai") as f:
                for line in f.read().decode().splitlines():
                    name, length, offset, bases, width = line.split("\t")[:5]
                    self.index[name] = int(length), int(offset), int(bases), int(width)
        except FileNotFoundError:
            if self.file.size() > SMALL:
                raise
            self._scan()

    def _scan(self) -> None:
        """The index of a small file, from its lines."""
        name, at = None, 0
        for line in self.file.read().splitlines(keepends=True):
            at += len(line)
            bases = line.rstrip(b"\r\n")
            if line.startswith(b">"):
                name = bases[1:].split()[0].decode()
                self.index[name] = 0, at, 1, 1
            elif name is not None and bases:
                length, offset, per, width = self.index[name]
                self.index[name] = (length + len(bases), offset, per, width) if length else (len(bases), offset, len(bases), len(line))

    @classmethod
    def of(cls, path: str) -> "Fasta":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __contains__(self, contig: str) -> bool:
        return contig in self.index

    def bases(self, contig: str, start: int, end: int) -> str:
        """Upper-case bases of [start, end), 0-based, cut at the sequence's ends."""
        length, offset, bases, width = self.index[contig]
        start, end = max(0, start), min(length, end)
        if start >= end:
            return ""
        at = offset + start // bases * width + start % bases
        stop = offset + (end - 1) // bases * width + (end - 1) % bases + 1
        data = self.file.read_at(stop - at, at)
        return data.replace(b"\n", b"").replace(b"\r", b"").decode().upper()


def reverse_complement(bases: str) -> str:
    return bases.translate(_COMPLEMENT)[::-1]
