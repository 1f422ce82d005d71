"""Operator 5, line dedup by winnowing over line hashes.

A text is seen as lines in two ways. Its own lines, hashed by their words, show repeated lines and runs of
them. Pieces, which ignore line ends and are cut after words whose hashes are least in some window of
PIECE words, show passages that begin and end inside lines or are wrapped differently: where a cut falls
depends on the words around it alone. In both ways, the span of a line is the shortest run of lines from
it on that has the least words (8 for lines, 33 for pieces); a gram is the same with half as many. Of the
grams within each span the one with the smallest hash is selected (the last of equal ones). What is
selected depends on the span alone, so two places that share a span share a fingerprint: that is
guaranteed, and pieces are short enough that a span lies within any 50 words that two places share.

Of equal texts only the first goes through this; later ones are deleted whole if they have the least words
of a line. Texts are cut and hashed once, to a table of units. Fingerprints are counted first; units are read again, and only fingerprints that occur twice go on. Their
spans are joined, by content, with the first place of each in order of doc_id and line; matches are
extended both ways as far as the lines agree, and the later run is deleted: lines go with their line
ends, and of lines that are left in part the words. The earliest place of any line is never deleted, so
one copy of all content stays. Of a passage inside lines, less than a piece may stay at either end.

A match is extended both ways by its neighbours: where lines before a span agree with the first place too,
the spans that start there lie within the agreement, occur there earlier and are matches of their own; so
does the span that starts a line later. What no span of its own covers is a rest of fewer words than the
least at the end, up to the line that would complete the next span: these lines alone go with a span and
are compared. So rows stay bounded, the join is of a row per span with one row per content, and a passage
that a third of all documents have is counted before its shuffle and split by the skewed join.

Defined results: blank lines are never deleted and do not interrupt a run; null text stays null and
counts as no lines; rows that share doc_id and text are one document and are treated alike, ties between
rows of one doc_id go to the smaller digest of the text; a null doc_id comes before all others; extra
columns are kept by the filter (n_lines, n_deleted and n_words_deleted are replaced) and ignored by the
report. Whole texts are read, very long ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from helixframe.llm.common import fresh, shared_folder, written

#: The least words of a run of lines, and of pieces; words of a window whose least hash ends a piece.
LINE_WORDS, PASSAGE_WORDS, PIECE = 8, 33, 8
LINES, PIECES, WHOLE = 0, 1, 2
#: Repeated fingerprints, repeated runs, and digests of equal texts, up to which they are broadcast (8, 16 and 32 bytes each).
BROADCAST_FINGERPRINTS, BROADCAST_RUNS, BROADCAST_COPIES = 4_000_000, 2_000_000, 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred so that all bits depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Base of the polynomials that hash runs, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run starts..ends (exclusive) of hashes, from the prefix sums of one polynomial."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes + np.uint64(seed)) * powers(BASE, len(hashes)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(hashes) + 1)[starts])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs (start, size), one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def bounds_of(column: pa.Array) -> np.ndarray:
    """Where the lists of a column begin and end in its flat values."""
    return np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))


def in_chunks(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about so much size each, a row at least."""
    for batch in batches:
        group = (np.cumsum(sizes(batch)) - 1) // limit
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))


def piece_ends(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces end (exclusive) in texts of words bounds[i]..bounds[i + 1]: after the least pair of words of each window of PIECE pairs, and at the end of each text."""
    own = bounds[1:][bounds[1:] > bounds[:-1]]
    m = len(hashes) - PIECE
    if m <= 0:
        return own
    pair = (hashes[1:] * np.uint64(BASE)) ^ (hashes[:-1] >> np.uint64(7))
    least, at = pair[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, PIECE):
        np.copyto(at, k, where=pair[k : k + m] < least)
        np.minimum(least, pair[k : k + m], out=least)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    within = text[:m] == text[PIECE:]
    cut = np.zeros(len(hashes) + 1, bool)
    cut[(at + np.arange(m) + 2)[within]] = cut[own] = True
    return np.flatnonzero(cut)


#: Bytes of texts, and units, that a task works on at once.
TEXT_BYTES, UNITS = 1 << 20, 50_000


def units(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """docs (id, digest, text) -> id, digest, kind, hashes and sizes (words) of the lines with words, or of the pieces, and their fingerprints fps with the first line lo and count of the spans that each stands for; no row for texts without words."""
    kind_of_id = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, lambda b: text_bytes(b.column(2)), TEXT_BYTES):
            words, hashes, sizes, ends, counts = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                n = 0
                for line in (text or b"").split(b"\n"):
                    parts = line.split()
                    if parts:
                        words += parts
                        hashes.append(xxhash.xxh64_intdigest(b" ".join(parts)))
                        sizes.append(len(parts))
                        n += 1
                counts.append(n)
                ends.append(len(words))
            counts, bounds, flat = np.array(counts), np.array([0, *ends]), word_hashes(words)
            keep = pa.array(np.flatnonzero(counts), pa.int32())
            lines = (np.array(hashes, np.uint64), np.array(sizes, np.int32), counts)
            cuts = piece_ends(flat, bounds)
            starts = np.append(0, cuts[:-1]) if len(cuts) else cuts
            pieces = (run_hashes(flat, starts, cuts), (cuts - starts).astype(np.int32), np.bincount(np.searchsorted(bounds[1:], starts, "right"), minlength=len(counts)))
            for kind, (h, size, each) in ((LINES, lines), (PIECES, pieces)):
                each = each[each > 0]
                own = np.append(0, np.cumsum(each))
                key, lo, hi, _ = winnowed(h, np.append(0, np.cumsum(size, dtype=np.int64)), own, least_of(kind, line_words))
                row = np.searchsorted(own, lo, "right") - 1
                n = np.bincount(row, minlength=len(each))
                picked = [lists((key ^ np.uint64(kind)).view(np.int64), n), lists((lo - own[row]).astype(np.int32), n), lists((hi - lo + 1).astype(np.int32), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(np.full(len(keep), kind, np.int32)), lists(h.view(np.int64), each), lists(size, each), *picked], names=["id", "digest", "kind", "hashes", "sizes", "fps", "lo", "spans"])

    return docs.mapInArrow(run, f"id {kind_of_id}, digest binary, kind int, hashes array<bigint>, sizes array<int>, fps array<bigint>, lo array<int>, spans array<int>")


def window_ends(total: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it on with the least words, by the words before each line; beyond the last end where there is none."""
    return np.searchsorted(total, total[:-1] + least)


def windows(words: list[int], least: int) -> list[int]:
    """The ends of window_ends of one text, of the lines that have one."""
    ends = window_ends(np.append(0, np.cumsum(np.array(words, np.int64))), least)
    return ends[ends <= len(words)].tolist()


def least_of(kind: int, line_words: int | None = None) -> int:
    return PASSAGE_WORDS if kind == PIECES else line_words or LINE_WORDS


def winnowed(hashes: np.ndarray, total: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(content, first and last line whose span selects it, end of the last span) of each selected gram, of texts of lines bounds[i]..bounds[i + 1].

    Spans that follow each other and select the same gram share a row.
    """
    end, gram = window_ends(total, least), window_ends(total, (least + 1) // 2)
    spans = np.flatnonzero(end <= np.repeat(bounds[1:], np.diff(bounds)))
    if not len(spans):
        return np.zeros(0, np.uint64), spans, spans, spans
    keys = run_hashes(hashes, np.arange(len(hashes)), np.minimum(gram, len(hashes)))
    last = np.searchsorted(gram, end[spans], "right") - 1  # of the grams within each span
    pick, best = spans.copy(), keys[spans]
    open_, k = np.flatnonzero(last > spans), 1
    while len(open_):  # those that have a k-th gram after their first
        at = spans[open_] + k
        smaller = keys[at] <= best[open_]
        pick[open_[smaller]], best[open_[smaller]] = at[smaller], keys[at[smaller]]
        open_, k = open_[last[open_] > at], k + 1
    first = np.append(True, pick[1:] != pick[:-1])
    final = np.append(first[1:], True)
    return best[first], spans[first], spans[final], end[spans[final]]


def winnow(hashes: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """winnowed for one text."""
    total = np.append(0, np.cumsum(np.array(words, np.int64)))
    key, lo, hi, _ = winnowed(np.array(hashes, np.uint64), total, np.array([0, len(hashes)]), least)
    return list(zip(key.tolist(), lo.tolist(), hi.tolist()))


def reach(end: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Up to where (exclusive) a match of the span from line at on must be extended: before the line that completes the next span, which is a match of its own."""
    following = end[np.minimum(at + 1, len(end) - 1)]
    return np.maximum(end[at], np.where((at + 1 < high) & (following <= high), following - 1, high))


def _of_one_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in in_chunks(batches, lambda b: b.column("hashes").value_lengths().to_numpy(zero_copy_only=False), UNITS):
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            yield kind, batch.take(pa.array(np.flatnonzero(kinds == kind)))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, words before each unit, and bounds of the rows."""
    hashes = batch.column("hashes").flatten().to_numpy().view(np.uint64)
    return hashes, np.append(0, np.cumsum(batch.column("sizes").flatten().to_numpy().astype(np.int64))), bounds_of(batch.column("hashes"))


def with_lines(split: DataFrame, line_words: int) -> DataFrame:
    """units -> a row per fingerprint: fp, id, digest, kind, the first line and count of the spans that it stands for, and their lines as far as matches are extended."""
    kind_of_id = split.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, batch in _of_one_kind(batches):
            hashes, total, bounds = _flat(batch)
            fps, first, spans = (batch.column(c).flatten() for c in ("fps", "lo", "spans"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds_of(batch.column("fps"))))
            lo = bounds[row] + first.to_numpy()
            size = reach(window_ends(total, least_of(kind, line_words)), lo + spans.to_numpy() - 1, bounds[row + 1]) - lo
            places, take, sizes = ranges(lo, size), pa.array(row, pa.int32()), np.diff(total).astype(np.int32)
            numbers = [fps, pa.array(np.full(len(row), kind, np.int32)), first, spans]
            held = [lists(hashes[places].view(np.int64), size), lists(sizes[places], size)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("digest").take(take), *numbers, *held], names=["id", "digest", "fp", "kind", "lo", "spans", "hashes", "sizes"])

    return split.mapInArrow(run, f"id {kind_of_id}, digest binary, fp long, kind int, lo int, spans int, hashes array<bigint>, sizes array<int>")


def spans_of(found: DataFrame, line_words: int) -> DataFrame:
    """A row per span of the fingerprints: its content, id, digest, kind, first line, size, and the lower halves of the hashes after it, as far as matches are extended."""
    kind_of_id = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, batch in _of_one_kind(batches):
            hashes, total, bounds = _flat(batch)
            least = least_of(kind, line_words)
            lo, spans = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "spans"))
            row = np.repeat(np.arange(batch.num_rows), spans)
            at = ranges(bounds[:-1], spans)
            ends = window_ends(total, least)
            end, more = ends[at], reach(ends, at, bounds[row + 1]) - ends[at]
            content = np.column_stack([run_hashes(hashes, at, end, 1 + kind), run_hashes(hashes, at, end, 3 + kind)])
            span = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(row), [None, pa.py_buffer(content.tobytes())]).cast(pa.binary())
            after = lists(hashes.astype(np.uint32).view(np.int32)[ranges(end, more)], more)
            same = [batch.column(c).take(pa.array(row, pa.int32())) for c in ("id", "digest", "kind")]
            yield pa.RecordBatch.from_arrays([*same, span, *[pa.array(x.astype(np.int32)) for x in (at - bounds[row] + lo[row], end - at)], after], names=["id", "digest", "kind", "span", "first", "size", "after"])

    return found.mapInArrow(run, f"id {kind_of_id}, digest binary, kind int, span binary, first int, size int, after array<int>")


def agreed(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def merged(found: DataFrame) -> DataFrame:
    """found (id, digest, runs) with runs that overlap or touch made one."""
    kind_of_id = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, first, last = (x.to_numpy().astype(np.int64) for x in batch.column("runs").flatten().flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds_of(batch.column("runs"))))
            group = (2 * row + kind) * (1 + last.max(initial=0))  # no run of a group goes beyond the next group's start
            order = np.argsort(group + first, kind="stable")
            row, kind, start, end = row[order], kind[order], (group + first)[order], np.maximum.accumulate((group + last)[order])
            fresh_run = np.append(True, (start[1:] > end[:-1]) | (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]))[: len(row)]
            at = np.flatnonzero(fresh_run)
            until = np.append(at[1:], len(row))[: len(at)] - 1
            base = group[order][at]
            parts = [pa.array(x.astype(np.int32)) for x in (kind[at], start[at] - base, end[until] - base)]
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[at], minlength=batch.num_rows))), pa.int32()), pa.StructArray.from_arrays(parts, names=["kind", "first", "last"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), runs], names=["id", "digest", "runs"])

    return found.select("id", "digest", "runs").mapInArrow(run, f"id {kind_of_id}, digest binary, runs array<struct<kind:int,first:int,last:int>>")


def repeated_runs(docs: DataFrame, folder: str, line_words: int = LINE_WORDS) -> DataFrame:
    """(id, digest, runs): later repeated runs as array<struct<kind, first, last>> over lines with words or pieces, last exclusive."""
    copies = docs.groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("p"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies.select(F.col("digest").alias("of"), F.col("p.id").alias("first_id")), folder, "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    met = docs.join(copies, F.col("digest") == F.col("of"), "left")
    later = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    whole = met.where(later).select("id", "digest").distinct().withColumn("runs", F.array(F.struct(F.lit(WHOLE).alias("kind"), F.lit(0).alias("first"), F.lit(0).alias("last"))))
    split = written(units(met.where(~later).select("id", "digest", "text"), line_words), folder, "units")  # texts are cut and hashed once
    twice = written(split.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), folder, "twice")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_FINGERPRINTS else twice
    again = written(with_lines(split, line_words).join(twice, "fp", "left_semi"), folder, "again")  # a table of its own: two kernels in one stage would hold two Python workers a core
    spans = written(spans_of(again, line_words), folder, "spans")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "digest", "first")
    firsts = spans.groupBy("span").agg(F.min(F.struct(place.alias("p"), F.col("after").alias("c"))).alias("f"), F.count("*").alias("n")).where("n > 1").select("span", "f.p", "f.c")
    firsts = written(firsts, folder, "firsts")  # a table of its own, so that Spark can split the join of a hot span
    met = spans.join(firsts, "span").where(~(F.col("id").eqNullSafe(F.col("p.id")) & (F.col("digest") == F.col("p.digest")) & (F.col("first") == F.col("p.first"))))
    end = F.col("first") + F.col("size") + agreed(F.col("after"), F.col("c"))
    runs = met.groupBy("id", "digest").agg(F.collect_set(F.struct("kind", "first", end.alias("last"))).alias("runs"))
    return merged(runs).unionByName(whole)


def without(text: str | None, runs: list[dict] | None, line_words: int = LINE_WORDS) -> tuple[str | None, int, int, int]:
    """text without the runs, the count of its lines with words, and of lines and words deleted."""
    if text is None:
        return None, 0, 0, 0
    held = text.encode("utf-8", "surrogatepass")
    if not runs:
        return text, sum(1 for line in held.split(b"\n") if line.strip()), 0, 0
    split = [line.split() for line in held.split(b"\n")]
    n = np.array([len(parts) for parts in split])
    size = int(n.sum())
    if not size:
        return text, 0, 0, 0
    gone = np.zeros(size, bool)
    if any(r["kind"] == WHOLE for r in runs):
        gone[:] = size >= line_words
    for kind in {r["kind"] for r in runs} - {WHOLE}:
        ends = np.cumsum(n[n > 0]) if kind == LINES else piece_ends(word_hashes([w for parts in split for w in parts]), np.array([0, size]))
        starts = np.append(0, ends)
        for r in runs:
            if r["kind"] == kind:
                gone[starts[r["first"]] : starts[r["last"]]] = True
    out, at, deleted = [], 0, 0
    for line, parts in zip(held.split(b"\n"), split):
        own, at = gone[at : at + len(parts)], at + len(parts)
        if parts and own.all():
            deleted += 1
        elif own.any():
            out.append(b" ".join(w for w, g in zip(parts, own) if not g))
        else:
            out.append(line)
    return b"\n".join(out).decode("utf-8", "surrogatepass"), int((n > 0).sum()), deleted, int(gone.sum())


ADDED = ("n_lines", "n_deleted", "n_words_deleted")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """docs with cleaned texts, runs of line_words and more in whole lines deleted where they repeat, all other columns as they are, and n_lines, n_deleted (lines) and n_words_deleted beside them (existing ones are replaced)."""
    folder = shared_folder(docs.sparkSession)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    runs = written(repeated_runs(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text")), folder, line_words), folder, "runs")
    small = (runs.agg(F.sum(F.size("runs") + 4)).first()[0] or 0) <= BROADCAST_RUNS  # of that many, texts need no shuffle
    rest = docs.drop(*ADDED)
    k_digest, k_id, k_runs = fresh(rest, "digest"), fresh(rest, "id"), fresh(rest, "runs")
    cut = runs.select(F.col("id").alias(k_id), F.col("digest").alias(k_digest + "_r"), F.col("runs").alias(k_runs))
    met = rest.withColumn(k_digest, digest).join(F.broadcast(cut) if small else cut, F.col(k_digest).eqNullSafe(F.col(k_digest + "_r")) & F.col(id_col).eqNullSafe(F.col(k_id)), "left")
    met = met.drop(k_digest, k_digest + "_r", k_id)
    at, runs_at = met.columns.index(text_col), len(met.columns) - 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, lambda b: text_bytes(b.column(at)), TEXT_BYTES):
            done = [without(text.as_py(), cuts.as_py(), line_words) for text, cuts in zip(batch.column(at), batch.column(runs_at))]
            texts, *counts = zip(*done) if done else ((), (), (), ())
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(runs_at)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in counts]], names=[*batch.schema.names[:runs_at], *ADDED])

    schema = StructType([f for f in met.schema.fields if f.name != k_runs])
    for name in ADDED:
        schema = schema.add(name, LongType())
    return met.mapInArrow(clean, schema)
