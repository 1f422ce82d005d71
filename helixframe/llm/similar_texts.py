"""SimHash near-duplicates at a Jaccard similarity of word shingles, with pigeonring filtering and an exact check.

Two texts link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. A SimHash
whose bits decide alone would need a budget of about a quarter of its bits to keep such links, and no key
of few bits finds candidates within that, so candidates come from the shingles themselves. All shingles
have one order, the same for all texts. Of n shingles, linked texts must share one of the first
n - ceil(0.8 n) + 1, so texts meet under these only, and under every one of them. The order puts shingles
that are common in a sample of the texts last, so common passages make few meetings; it decides what is
compared, never what links. Pairs that meet are kept while their sizes and the places of the met shingle
leave 0.8 possible if it is the first they share, then while some chain of consecutive segments of their
SimHashes of 256 bits stays within proportional budgets up to the whole (pigeonring), and are at last
compared by their whole sets. The budget of 80 bits is five deviations from what texts of similarity 0.8
differ in. In the last round pairs must have enough shingles in common by counts of their hashes in 256
bins (those in common are at most the sum of the lesser counts) before they leave the task they meet in.

Texts of equal sets count once. Rounds that compare each text with one neighbour of another component join
large groups of near copies with few comparisons. Then each text is compared with a few that it can link with, and a
last round compares all pairs that are still apart. A step's links join components, not texts: their ends are
replaced by what has been joined before, so links of a large group are walked once.
A shingle with more texts than a block is dealt out as pairs of blocks.

Defined results: null and empty texts have the empty set and link with each other; texts of under five
words are one shingle; rows of one doc_id, null ids and extra columns are as in simhash_dedup. A
component keeps the document of its smallest id. Shingles and sets are compared by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from helixframe.llm.common import partitions, shared_folder, written
from helixframe.llm.components import components
from helixframe.llm.language_id import mixed
from helixframe.llm.simhash_dedup import keep_least

SHINGLE, SEED = 5, 42
#: The least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
#: Texts of one shingle that are compared as one block.
BLOCK = 2048
#: One text of so many is sampled for the order of shingles; shingles in fewer sampled texts count as rare; most that are told to tasks.
SAMPLED, OFTEN, TOLD = 32, 4, 1 << 16
#: Words of 64 bits of a SimHash, each a segment, and the bits that linked texts may differ in.
SEGMENTS, MOST_BITS = 4, 80
SIM = [f"sim{k}" for k in range(SEGMENTS)]
#: Bins of a set's counts, and the count from which a bin says nothing.
BINS, FULL = 256, 255
#: Rounds of neighbours at most, before all pairs; a round of which fewer than one pair in so many links is the last.
ROUNDS, FRUITFUL = 3, 4
#: Texts that each text of a bucket is compared with before all pairs.
FEW = 4
#: Texts up to which the ids of those to be compared by whole sets are broadcast; beyond, texts are joined.
NAMED = 1_000_000
#: Texts whose sets are held at once in a task.
ROWS = 256


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), "<u8"))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view("<i8")))


def simhash(s: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: a bit is set where it is in more than half of them."""
    out = np.empty(SEGMENTS, "<u8")
    for k in range(SEGMENTS):
        h = mixed(s + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            bits += np.add.reduce(np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
        out[k] = np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0]
    return out


def binned(s: np.ndarray) -> np.ndarray:
    """The set's counts by bins, a byte each."""
    return np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8)


def in_bins(one: np.ndarray, two: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether counts by bins leave so similar sets possible."""
    full = (one == FULL).any(1) | (two == FULL).any(1)
    shared, sizes = np.minimum(one, two).sum(1, dtype=np.int64), one.sum(1, dtype=np.int64) + two.sum(1, dtype=np.int64)
    return full | ((least[0] + least[1]) * shared >= least[0] * sizes)


def in_budget(one: np.ndarray, two: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Whether SimHashes (rows of segments) differ in no more bits: a chain of consecutive segments, from some start
    on the ring, has cumulative differences within the budget's share of its length, at every length up to all segments."""
    out = np.zeros(len(one), bool)
    if not len(one):
        return out
    away = np.bitwise_count(one ^ two).astype(np.int64)
    budgets = [most * (k + 1) // SEGMENTS for k in range(SEGMENTS)]
    for start in range(SEGMENTS):
        live, total = np.flatnonzero(~out), 0
        for k in range(SEGMENTS):  # short chains drop most pairs before the whole is summed
            total = total + away[live, (start + k) % SEGMENTS]
            keep = total <= budgets[k]
            live, total = live[keep], total[keep]
        out[live] = True
    return out


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """The shingles of a set, rare ones first, of which linked texts must share one."""
    at = np.searchsorted(common[0], s)
    count = np.append(common[1], 0)[at] * (np.append(common[0], np.uint64(0))[at] == s)
    return s[np.lexsort((s, count))][: len(s) - -(-len(s) * least[0] // least[1]) + 1]


def with_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, common: tuple[np.ndarray, np.ndarray] | None = None, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, node, n, grams): node is a digest of a text's set, n the set's size, grams the whole set.

    With common (hashes in order, their counts) grams is its prefix, and sim0.. and bins, its SimHash and
    its counts by bins, come besides.
    """
    kind = df.schema[id_col].dataType.simpleString()
    more = [] if common is None else [*SIM, "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, ROWS):
                batch = rows.slice(at, ROWS)
                sets = [shingles(t.as_py(), shingle) for t in batch.column(1)]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], "<u8").view("<i8")
                columns = [batch.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), lists(sets if common is None else [prefix(s, common, least) for s in sets])]
                if more:
                    columns += [*(pa.array(x) for x in np.stack([simhash(s) for s in sets]).view("<i8").T), pa.array([binned(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "grams", *more])

    kinds = ", ".join(f"{x} {'binary' if x == 'bins' else 'long'}" for x in more)
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, node long, n int, grams array<long>" + (", " + kinds if more else ""))


def common_shingles(df: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled texts and their counts, by hash. They only order shingles."""
    some = with_sets(df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(SAMPLED)) == 0), id_col, text_col, shingle)
    counts = some.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    found = counts.orderBy(F.desc("c"), "gram").limit(TOLD).collect()
    gram, c = np.array([r.gram for r in found], "<i8").view("<u8"), np.array([r.c for r in found], np.int64)
    order = np.argsort(gram)
    return gram[order], c[order]


def possible(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of n1 and n2 shingles whose first one in common is at places p1 and p2 of the order can be as similar as least."""
    return (least[0] + least[1]) * np.minimum(n1 - p1, n2 - p2) >= least[0] * (n1 + n2)


def by_bucket(keyed: DataFrame, names: list[str], found, schema: str) -> DataFrame:
    """found(rows, group) of the rows of whole buckets: rows of longs, bucket by bucket and sorted by the columns, and the bucket's number of each. A last binary column of even width counts as so many longs."""
    keys = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([np.frombuffer(b"".join(c.to_pylist()), "<i8").reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]).astype(np.int64, copy=False)
            last = held[-1][-1:] if held else rows[:1]
            change = (np.diff(np.concatenate([last, rows])[:, :keys], axis=0) != 0).any(1)
            if not change.any():
                held.append(rows)
                continue
            cut = np.flatnonzero(change)[-1]
            yield from done([*held, rows[:cut]])
            held = [rows[cut:]]
        if held:
            yield from done(held)

    def done(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        if len(rows):
            group = np.concatenate([[0], np.cumsum((np.diff(rows[:, :keys], axis=0) != 0).any(1))])
            yield from found(rows, group)

    order = [f.name for f in keyed.schema if not isinstance(f.dataType, BinaryType)]
    dealt = keyed.repartition(partitions(keyed.sparkSession), *names).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def met_texts(firsts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(gram, n, node, pos) of shingles that two texts or more meet under, of texts that can have a partner there."""
    up, down = least

    def found(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = np.bincount(group)[group] > 1
        rows, group = rows[many], group[many]
        if not len(rows):
            return
        n, pos = rows[:, 1], rows[:, 3]
        # the sizes of a bucket grow, so they are looked up in one array of bucket and size
        width = int(n.max()) + 2
        place = group * width + n
        smallest = -(-up * n // down)
        # as the larger one, a text meets sizes that leave its place early enough; as the smaller one, its place must be early by itself
        largest = np.minimum(n, ((down) * n - (up + down) * pos) // up)
        below = np.searchsorted(place, group * width + largest, "right") - np.searchsorted(place, group * width + smallest, "left")
        own = largest >= n
        above = np.searchsorted(place, group * width + np.minimum(n * down // up, width - 1), "right") - np.searchsorted(place, place, "left")
        keep = (below > own) | (own & (above > 1))
        yield pa.RecordBatch.from_arrays([pa.array(rows[keep, i]) for i in range(4)], names=["gram", "n", "node", "pos"])

    keyed = firsts.select(F.col("n").cast("long").alias("n"), "node", F.posexplode("grams").alias("pos", "gram")).select("gram", "n", "node", F.col("pos").cast("long").alias("pos"))
    return by_bucket(keyed, ["gram"], found, "gram long, n long, node long, pos long")


#: What a bucket's row holds behind its key.
ROW = ["n", "node", "pos", "root", *SIM]


def with_roots(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """met with the root of each text, which is itself where nothing links it."""
    if roots is None:
        return met.withColumn("root", F.col("node"))
    return met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def in_order(one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(one):
        pairs = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def neighbour_pairs(rooted: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b), a < b: in each shingle's texts by size, where the root changes, the texts on both sides if they can link."""

    def found(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, node, pos, root = rows[:, 1:5].T
        sim = np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
        i = np.flatnonzero((group[1:] == group[:-1]) & (root[1:] != root[:-1]))
        i = i[possible(n[i], pos[i], n[i + 1], pos[i + 1], least)]
        i = i[in_budget(sim[i], sim[i + 1])]
        yield from in_order(node[i], node[i + 1])

    return by_bucket(rooted.select("gram", *ROW), ["gram"], found, "a long, b long").distinct()


def first_met(met: DataFrame) -> DataFrame:
    """Each text's first row of met: where its copies, near ones too, mostly meet it."""
    first = met.groupBy("node").agg(F.min(F.struct("pos", "gram", "n", *SIM)).alias("first"))
    return first.select("first.gram", "first.n", "node", "first.pos", *[f"first.{x}" for x in SIM])


def in_blocks(rooted: DataFrame, block: int) -> DataFrame:
    """rooted with (b1, b2): a shingle with more texts than a block is dealt out as pairs of blocks, others are (0, 0)."""
    counts = rooted.groupBy("gram").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = counts.where("low <> high").select("gram", F.when(F.col("c") > block, F.ceil(F.col("c") / F.lit(block / 2)).cast("int")).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).cast("long").alias("b1"), F.greatest(own, o).cast("long").alias("b2")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2")))
    return rooted.join(counts, "gram").select("gram", *ROW, F.explode(F.coalesce(pair, alone)).alias("p")).select("gram", "p.b1", "p.b2", *ROW)


def apart(rows: np.ndarray, group: np.ndarray, least: tuple[int, int], room: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of one bucket (gram, b1, b2, ROW ..) that can link by size, place and SimHash and whose roots differ; of rows without room (the caller keeps it) no more as the first of a pair."""
    n, _, pos, root = rows[:, 3:7].T
    sim = np.ascontiguousarray(rows[:, 7 : 7 + SEGMENTS]).view(np.uint64)
    at, k = np.arange(len(rows)), 1
    while True:
        at = at[at + k < len(rows)]
        at = at[(group[at] == group[at + k]) & (least[0] * n[at + k] <= least[1] * n[at])]  # in a bucket sizes only grow
        if room is not None:
            at = at[room[at] > 0]
        if not len(at):
            return
        i = at[root[at] != root[at + k]]
        i = i[possible(n[i], pos[i], n[i + k], pos[i + k], least)]
        i = i[in_budget(sim[i], sim[i + k])]
        yield i, i + k
        k += 1


KEYS = ["gram", "b1", "b2"]


def open_rows(rooted: DataFrame, least: tuple[int, int], block: int) -> DataFrame:
    """Rows of buckets (gram, b1, b2, ROW) that have any pair by SimHash whose roots differ: as many as rows at most."""

    def told(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.zeros(len(rows), bool)
        for i, j in apart(rows, group, least):
            some[i] = some[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[some].T], names=[*KEYS, *ROW])

    return by_bucket(in_blocks(rooted, block), KEYS, told, ", ".join(f"{c} long" for c in [*KEYS, *ROW]))


def cross_pairs(some: DataFrame, bins: DataFrame, least: tuple[int, int], few: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of open rows that can link by their bins too and whose roots differ, or so many of each row as the smaller text."""

    def found(rows: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = np.ascontiguousarray(rows[:, 7 + SEGMENTS :]).view(np.uint8)
        room = None if few is None else np.full(len(rows), few)
        left, right = [], []
        for i, j in apart(rows, group, least, room):
            ok = in_bins(counts[i], counts[j], least)
            left.append(rows[i[ok], 4])
            right.append(rows[j[ok], 4])
            if room is not None:
                room[i[ok]] -= 1
        if left:
            yield from in_order(np.concatenate(left), np.concatenate(right))

    return by_bucket(some.join(bins, "node").select(*KEYS, *ROW, "bins"), KEYS, found, "a long, b long").distinct()


def still_apart(some: DataFrame, roots: DataFrame) -> DataFrame:
    """Open rows with the roots as they are now, of buckets where these differ."""
    rooted = with_roots(some.drop("root"), roots).select(*KEYS, *ROW)
    differ = rooted.groupBy(*KEYS).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rooted.join(differ.select(*KEYS), KEYS, "left_semi")


def joined(roots: DataFrame | None, links: DataFrame, folder: str) -> DataFrame:
    """(node, root) with the links: only what they join is walked, a component being one node."""
    if roots is None:
        return components(links, folder)
    ends = links
    for x in "ab":
        ends = ends.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(x, F.coalesce(f"root_{x}", x)).drop(f"root_{x}")
    ends = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "ends")
    more = components(ends, folder)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("low")), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return written(moved.unionByName(more.join(roots, "node", "left_anti")), folder, "joined")


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK, named: int = NAMED, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, component_id (the smallest doc_id reachable)."""
    folder = shared_folder(df.sparkSession)
    common = common_shingles(df, id_col, text_col, shingle)
    docs = written(with_sets(df, id_col, text_col, shingle, common, least), folder, "firsts")
    lowest = written(docs.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(x).alias(x) for x in SIM]), folder, "distinct")
    met = met_texts(docs.select("node", "n", "grams").dropDuplicates(["node"]), least)
    met = written(met.join(lowest.drop("least"), "node"), folder, "met")

    def linked(pairs: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        """The pairs whose whole sets are as similar as least, their count and that of all; texts are read again for the ends of pairs alone."""
        pairs = written(pairs, folder, f"{name}_pairs")
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), folder, f"{name}_ends")
        ids = lowest.join(ends, "node").select("least").distinct()
        few = ends.count() <= named
        some = df.join(F.broadcast(ids) if few else ids, F.col(id_col).eqNullSafe(F.col("least")), "left_semi")
        sets = with_sets(some, id_col, text_col, shingle).join(F.broadcast(ends) if few else ends, "node", "left_semi")
        sets = written(sets.select("node", "n", "grams"), folder, f"{name}_sets").dropDuplicates(["node"])
        a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        found = written(pairs.join(a, "a").join(b, "b").where(shared * (least[0] + least[1]) >= least[0] * (F.col("n_a") + F.col("n_b"))).select("a", "b"), folder, name)
        return found, found.count(), pairs.count()

    roots = None
    for k in range(rounds + 1):
        # groups are joined by a pair for each text before all shingles are looked at; what a round leaves is found by the last steps
        more, n, of = linked(neighbour_pairs(with_roots(met if k else first_met(met), roots), least), f"links_{k}")
        if n:
            roots = joined(roots, more, f"{folder}/components_{k}")
        if k and FRUITFUL * n <= of:
            break
    bins = docs.select("node", "bins").dropDuplicates(["node"])
    some = written(open_rows(with_roots(met, roots), least, block), folder, "open")
    for name, few in (("few", FEW), ("last", None)):
        more, n, _ = linked(cross_pairs(some, bins, least, few), f"links_{name}")
        if not n:
            continue
        roots = joined(roots, more, f"{folder}/components_{name}")
        if few is not None:
            some = written(still_apart(some, roots), folder, "still_open")
    of = lowest.select("node", "least")
    of = of.withColumn("root", F.col("node")) if roots is None else of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.select("doc_id", "node").join(of.join(low, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """df with the document of the smallest id of each component, one row of it; all columns are kept.

    Rows without an id stay only where their whole component has none (then all of them).
    """
    return keep_least(df, similar_texts(df, id_col, text_col, shingle, least), id_col)
