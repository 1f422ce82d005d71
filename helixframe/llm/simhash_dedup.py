"""Operator 7, SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits. Two fingerprints link at three or fewer differing bits. Seen as
four segments on a ring, such a pair has a start from which the cumulative differences of 1, 2, 3
and 4 consecutive segments stay within 0, 1, 2 and 3 bits. So both fingerprints meet under the key
of the start's segment, and where such a bucket is large, under the keys of that segment and the
next one with one bit left out. Inside a bucket, pairs must pass the chain of budgets before the
full Hamming check. Distinct fingerprints only are compared. A key with more of them than a block
holds is dealt out as pairs of blocks, so no task holds more than two blocks of one key, and what
leaves a task is a spanning forest of the links it found, not the pairs.

Defined results: null and empty texts have fingerprint zero, which links like any other; texts of
one or two words are one shingle; repeated rows and rows of one doc_id are each returned; a null
doc_id stays null and is never the smallest unless all of its component are null, where
component_id is null. Extra columns are ignored by the report; the filter keeps all columns. Whole
texts are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, partitions, shared_folder, written
from helixframe.llm.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
SEGMENTS, WIDTH = 4, 16
#: Cumulative differing bits that a chain of 1, 2, 3 and 4 segments may have: the floor of k * 3 / 4.
BUDGETS = tuple((k + 1) * MOST_BITS // SEGMENTS for k in range(SEGMENTS))
#: Distinct fingerprints of a key that are compared as one block.
BLOCK = 2048
#: Ids to drop up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned bits in a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def linked_pairs(group: np.ndarray, start: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of one group whose fingerprints link; rows of a group are contiguous, start is its segment.

    The k-th round compares each row with the k-th after it, so work is that of the pairs.
    """
    left, right = [], []
    turn = (start * WIDTH).astype(np.uint64)
    ring = (fp >> turn) | (fp << ((np.uint64(64) - turn) % np.uint64(64)))  # the start's segment comes first
    at, k = np.arange(len(fp)), 1
    while True:
        at = at[at + k < len(fp)]
        at = at[group[at] == group[at + k]]
        if not len(at):
            break
        i, diff = at, ring[at] ^ ring[at + k]
        for length, budget in enumerate(BUDGETS, 1):  # the last one is the full Hamming check
            mask = np.uint64((1 << (WIDTH * length)) - 1) if length < SEGMENTS else np.uint64(2**64 - 1)
            passed = np.bitwise_count(diff & mask) <= budget
            i, diff = i[passed], diff[passed]
        left.append(i)
        right.append(i + k)
        k += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def bucket_links(keyed: DataFrame) -> DataFrame:
    """keyed (start, key.., fp), sorted by key within partitions -> links (a, b) of a spanning forest of each bucket."""
    names = [c for c in keyed.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = np.column_stack([np.asarray(c) for c in batch.columns]).astype(np.int64)
            rows = new if held is None else np.concatenate([held, new])
            if not len(rows):
                continue
            change = (rows[1:, :-1] != rows[:-1, :-1]).any(1)
            last = np.flatnonzero(change)[-1] + 1 if change.any() else 0
            held = rows[last:]
            if last:
                yield found(rows[:last])
        if held is not None and len(held):
            yield found(held)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((rows[1:, :-1] != rows[:-1, :-1]).any(1))])
        fp = rows[:, -1].copy().view(np.uint64)
        label = forest(len(rows), *linked_pairs(group, rows[:, 0].astype(np.uint64), fp))
        own = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[own, -1]), pa.array(rows[label[own], -1])], names=["a", "b"])

    dealt = keyed.repartition(partitions(keyed.sparkSession), *names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a long, b long")


def blocks(keyed: DataFrame, counts: DataFrame, names: list[str], block: int) -> DataFrame:
    """Rows of keys over a block, dealt to pairs of blocks b1 <= b2 that each hold them; other rows as pair (0, 0)."""
    many = counts.where(F.col("n") > block).select(*names, F.ceil(F.col("n") / F.lit(block / 2)).cast("int").alias("blocks"))
    met = keyed.join(many, names, "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("b1"), F.greatest(own, o).alias("b2")))
    alone = F.array(F.struct(F.lit(0).alias("b1"), F.lit(0).alias("b2")))
    return met.select(*names, F.explode(F.coalesce(pair, alone)).alias("p"), "fp").select(*names, "p.b1", "p.b2", "fp")


def fingerprint_links(distinct: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints of distinct (fp) with three or fewer differing bits, directly or over others."""
    turned = lambda i: F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    each = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), turned(i).alias("seg"), turned((i + 1) % SEGMENTS).alias("next")) for i in range(SEGMENTS)])).alias("k")).select("k.*", "fp")
    each = written(each, folder, "starts")
    counts = each.groupBy("start", "seg").agg(F.count("*").alias("n"))  # 4 x 65,536 keys at most
    large = F.broadcast(counts.where(F.col("n") > block).select("start", "seg"))
    few = each.join(large, ["start", "seg"], "left_anti").select("start", "seg", "fp")
    # a large bucket is refined: the next segment differs in one bit at most, so the pair agrees once that bit is left out
    many = each.join(large, ["start", "seg"])
    bits = F.array(*[F.struct(F.lit(j).alias("bit"), F.col("next").bitwiseAND(F.lit(0xFFFF ^ (1 << j))).alias("rest")) for j in range(WIDTH)])
    many = many.select("start", "seg", F.explode(bits).alias("k"), "fp").select("start", "seg", "k.bit", "k.rest", "fp")
    names = ["start", "seg", "bit", "rest"]
    dealt = blocks(many, many.groupBy(*names).agg(F.count("*").alias("n")), names, block)
    return bucket_links(few).union(bucket_links(dealt))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    folder = shared_folder(df.sparkSession)
    docs = written(with_fingerprints(df, id_col, text_col), folder, "fingerprints")
    by_print = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    links = written(fingerprint_links(by_print.select("fp"), folder, block), folder, "found")
    roots = components(links.select("a", "b"), folder)
    of = by_print.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the document of the smallest id of each component, one row of it; all columns are kept.

    Rows without an id stay only where their whole component has none (then all of them).
    """
    return keep_least(df, near_duplicates(df, id_col, text_col), id_col)


def keep_least(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row of df for each doc_id of found that is its component_id; all rows without an id where that is null."""
    own = F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")
    key, folder = fresh(df, "id"), shared_folder(df.sparkSession)
    per = written(found.groupBy(F.col("doc_id").alias(key)).agg(F.sum(own).alias("n")).where("n <> 1"), folder, "not_once")
    few = per.count() <= BROADCAST_IDS  # then texts stay where they are
    gone, again = per.where("n = 0").select(key), per.where(f"n > 1 and `{key}` is not null").select(key)
    told = lambda ids: F.broadcast(ids) if few else ids
    kept = df.join(told(gone), F.col(id_col).eqNullSafe(F.col(key)), "left_anti")
    if not again.take(1):
        return kept
    once = kept.join(told(again), F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col])
    return kept.join(told(again), F.col(id_col) == F.col(key), "left_anti").unionByName(once)
