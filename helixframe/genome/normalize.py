"""Left-aligned, parsimonious forms of variants."""

from __future__ import annotations

from dataclasses import dataclass

from helixframe.genome.fasta import Fasta

#: Reference bases that are put before the alleles at a time.
PAD = 100


@dataclass
class Normalized:
    start: int | None
    end: int | None
    ref: str | None
    alts: list[str] | None
    changed: bool
    error: str | None = None


def shared_end(alleles: list[str]) -> int:
    """How many last bases all alleles share."""
    n = 0
    shortest = min(map(len, alleles))
    while n < shortest and len({a[len(a) - 1 - n] for a in alleles}) == 1:
        n += 1
    return n


def shared_start(alleles: list[str]) -> int:
    """How many first bases all alleles share and can lose while each keeps one."""
    n = 0
    while min(map(len, alleles)) > n + 1 and len({a[n] for a in alleles}) == 1:
        n += 1
    return n


def normalize(contig: str, start: int, end: int, ref: str | None, alts: list[str] | None, fasta: Fasta) -> Normalized:
    if not ref:
        return Normalized(None, None, None, None, False, "No REF or ALT alleles found.")
    if not alts:
        return Normalized(start, end, ref[0], [], True)
    alleles = [ref, *alts]
    symbolic = any(not set(a.upper()) <= set("ACGTN") for a in alleles)
    if symbolic or (all(len(a) == 1 for a in alleles)):
        return Normalized(start, end, ref, list(alts), False)
    at, trimmed = start, 0
    while True:
        n = shared_end(alleles)
        shortest = min(map(len, alleles))
        if n < shortest or at == 0:
            n = min(n, shortest - 1)
            alleles = [a[: len(a) - n] for a in alleles]
            trimmed += n
            break
        # an allele is used up: go on with bases of the reference before it
        alleles = [a[: len(a) - n] for a in alleles]
        trimmed += n
        pad = fasta.bases(contig, at - PAD, at)
        if not pad:
            break
        alleles = [pad + a for a in alleles]
        at -= len(pad)
    left = shared_start(alleles)
    alleles = [a[left:] for a in alleles]
    return Normalized(at + left, end - trimmed, alleles[0], alleles[1:], trimmed > 0 or left > 0)
