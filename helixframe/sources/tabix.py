"""Tabix indexes of block-gzip files: building, reading, and the byte ranges of an interval.

An index deals the lines of a contig to bins of six sizes, from 16,384 places to 2^29; a line is in the
smallest bin that holds it. For each bin it lists stretches of the file as virtual offsets (a block's
offset and, in the low 16 bits, the place in its data), and for each 16,384 places the first offset of
a line that reaches them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.files import BGZF_END, bgzf_blocks, bgzf_compress, is_bgzf, listed, opened, uri

#: Fixed values of the format: bits of the smallest bins, levels, and the end of all places.
SMALLEST, LEVELS, LIMIT = 14, 6, 1 << 29
MAGIC = b"TBI\x01"
#: Compressed bytes between two stretches that are read over rather than skipped.
GAP = 1 << 16


@dataclass(frozen=True)
class Interval:
    """Rows of a contig (any, if None) that overlap [start, end)."""

    contig: str | None = None
    start: int = 0
    end: int = LIMIT


@dataclass
class Contig:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)


def first_bin(level: int) -> int:
    return (8**level - 1) // 7


def bins_of(start: int, end: int) -> Iterator[tuple[int, int]]:
    """(level, bin) of all bins that overlap the places, from the largest level down."""
    last = max(start, end - 1)
    for level in range(LEVELS):
        shift = SMALLEST + 3 * (LEVELS - 1 - level)
        for b in range(start >> shift, (last >> shift) + 1):
            yield level, first_bin(level) + b


def own_bin(start: int, end: int) -> int:
    """The smallest bin that holds the places."""
    last = max(start, end - 1)
    for level in range(LEVELS - 1, -1, -1):
        shift = SMALLEST + 3 * (LEVELS - 1 - level)
        if start >> shift == last >> shift:
            return first_bin(level) + (start >> shift)
    return 0


def located_lines(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(virtual offset, that of the end, line) of a block-gzip file."""
    with opened(path) as f:
        rest, begun = b"", 0
        for at, data in bgzf_blocks(f, 0, None):
            if not rest:
                begun = at << 16
            low = 0
            while (cut := data.find(b"\n", low)) >= 0:
                after = (at << 16) + cut + 1
                yield begun, after, rest + data[low:cut]
                rest, low, begun = b"", cut + 1, after
            rest += data[low:]
        if rest:
            yield begun, begun + len(rest), rest


def line_interval(line: bytes) -> tuple[str, int, int]:
    """Contig, start and end (0-based, half-open) of a VCF line."""
    c = line.split(b"\t", 8)
    start = int(c[1]) - 1
    end = next((int(x[4:]) for x in c[7].rstrip().split(b";") if x.startswith(b"END=") and x[4:].isdigit()), start + len(c[3])) if len(c) > 7 else start + len(c[3])
    return c[0].decode(), start, max(end, start + 1)


def indexed(path: str) -> dict[str, Contig]:
    """The index of a block-gzip VCF file whose lines are sorted within contigs."""
    out: dict[str, Contig] = {}
    before = ("", -1)
    for begun, ended, line in located_lines(path):
        if not line.strip() or line.startswith(b"#"):
            continue
        name, start, end = line_interval(line)
        if name == before[0] and start < before[1] or name != before[0] and name in out:
            raise ValueError(f"{path} is not sorted at {name}:{start + 1}")
        if not 0 <= start < LIMIT:
            raise ValueError(f"{path} has a place that the index cannot hold: {name}:{start + 1}")
        before = (name, start)
        contig = out.setdefault(name, Contig())
        held = contig.bins.setdefault(own_bin(start, min(end, LIMIT)), [])
        if held and held[-1][1] == begun:
            held[-1] = (held[-1][0], ended)
        else:
            held.append((begun, ended))
        for window in range(len(contig.linear), (min(end, LIMIT) - 1 >> SMALLEST) + 1):
            contig.linear.append(begun if window >= start >> SMALLEST else contig.linear[-1] if contig.linear else begun)
    return out


def packed(index: dict[str, Contig]) -> bytes:
    names = b"".join(n.encode() + b"\0" for n in index)
    out = [MAGIC, struct.pack("<8i", len(index), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for contig in index.values():
        out.append(struct.pack("<i", len(contig.bins)))
        for b, chunks in contig.bins.items():
            out.append(struct.pack("<Ii", b, len(chunks)))
            out += [struct.pack("<QQ", *c) for c in chunks]
        out.append(struct.pack(f"<i{len(contig.linear)}Q", len(contig.linear), *contig.linear))
    return bgzf_compress(b"".join(out)) + BGZF_END


def unpacked(data: bytes) -> dict[str, Contig]:
    out, at = [], 0
    while at < len(data):  # a member for each block
        z = zlib.decompressobj(wbits=31)
        out.append(z.decompress(data[at:]))
        at = len(data) - len(z.unused_data)
    raw = b"".join(out)
    if raw[:4] != MAGIC:
        raise ValueError("not a tabix index")
    n, _, _, _, _, _, _, size = struct.unpack_from("<8i", raw, 4)
    names = raw[36 : 36 + size].split(b"\0")[:n]
    at, index = 36 + size, {}
    for name in names:
        contig = index[name.decode()] = Contig()
        (bins,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(bins):
            b, chunks = struct.unpack_from("<Ii", raw, at)
            held = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            at += 8 + 16 * chunks
            if b <= first_bin(LEVELS):  # later numbers hold statistics of the contig
                contig.bins[b] = list(zip(held[::2], held[1::2]))
        (windows,) = struct.unpack_from("<i", raw, at)
        contig.linear = list(struct.unpack_from(f"<{windows}Q", raw, at + 4))
        at += 4 + 8 * windows
    return index


def stretches(index: dict[str, Contig], want: Interval) -> list[tuple[int, int]]:
    """Sorted stretches of virtual offsets that hold all lines of the interval (and some others)."""
    out: list[tuple[int, int]] = []
    for name, contig in index.items():
        if want.contig not in (None, name):
            continue
        low, high = max(0, want.start), min(want.end, LIMIT)
        if low >= high:
            continue
        window = low >> SMALLEST
        # a place beyond the last window has no lines
        least = contig.linear[window] if window < len(contig.linear) else (contig.linear[-1] if contig.linear else 0)
        if high - low < LIMIT // 64:
            found = [c for _, b in bins_of(low, high) for c in contig.bins.get(b, ())]
        else:
            overlapping = lambda b, level: (b - first_bin(level)) << (s := SMALLEST + 3 * (LEVELS - 1 - level)) < high and (b - first_bin(level) + 1) << s > low
            found = [c for b, chunks in contig.bins.items() if overlapping(b, next(k for k in range(LEVELS) if b < first_bin(k + 1))) for c in chunks]
        out += [c for c in found if c[1] > least]
    joined: list[tuple[int, int]] = []
    for begun, ended in sorted(out):
        if joined and (begun >> 16) - (joined[-1][1] >> 16) <= GAP:
            joined[-1] = (joined[-1][0], max(joined[-1][1], ended))
        else:
            joined.append((begun, ended))
    return joined


def index_of(path: str) -> dict[str, Contig] | None:
    """The index beside a block-gzip file, if there is one that is not older than the file."""
    fs, p = pafs.FileSystem.from_uri(uri(path))
    own, beside = fs.get_file_info([p, p + ".tbi"])
    if beside.type != pafs.FileType.File or own.mtime and beside.mtime and beside.mtime < own.mtime:
        return None
    with opened(path) as f:
        if not is_bgzf(f.read(18)):
            return None
    with opened(path + ".tbi") as f:
        return unpacked(f.read())


def stretch_lines(path: str, begun: int, ended: int) -> Iterator[bytes]:
    """The lines between two virtual offsets; both are where a line begins or ends."""
    with opened(path) as f:
        rest = b""
        for at, data in bgzf_blocks(f, begun >> 16, (ended >> 16) + 1):
            low = begun & 0xFFFF if at == begun >> 16 else 0
            high = ended & 0xFFFF if at == ended >> 16 else len(data)
            lines = (rest + data[low:high]).split(b"\n")
            rest = lines.pop()
            yield from lines
        if rest:
            yield rest


def within(line: bytes, want: Interval) -> bool:
    name, start, end = line_interval(line)
    return want.contig in (None, name) and start < want.end and end > want.start


def write_tabix_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Writes an index beside each block-gzip VCF file, a file to a task; returns (path, contigs, bytes)."""
    paths = [p for p, _ in listed(spark, path) if not p.endswith(".tbi")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                made = indexed(p)
                data = packed(made)
                fs, target = pafs.FileSystem.from_uri(uri(p) + ".tbi")
                with fs.open_output_stream(target, compression=None) as f:
                    f.write(data)
                rows.append((p, len(made), len(data)))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "contigs", "bytes"])

    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return spark.createDataFrame(todo.mapInArrow(run, "path string, contigs long, bytes long").collect(), "path string, contigs long, bytes long")
