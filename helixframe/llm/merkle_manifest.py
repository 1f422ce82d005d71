"""Operator 12, a Merkle manifest of a dataset by rolled-up nested structs.

A leaf is a digest of a row. Leaves of a source are ranked by id, and the rank's hexadecimal digits
are grouped away one after the other: runs of sixteen become a struct that nests its children, then
sixteen of those, and so on, for three digits, so that a nested row is a block of 4,096 leaves at
most. Blocks' own digests are ranked by their number and rolled up in the same way, tier by tier,
until each source has one digest left; sources' digests are rolled up likewise. On the way back an
explode of each level hands down the digests of its run, so a leaf's proof needs no join with its
siblings; the only joins are of a block with the path above it, a row for 4,096 leaves.

Defined results: a null column enters the leaf as a mark; null ids come first in their source and a
null source is one of its own, before the others; rows of one id follow by digest, and repeated rows
are leaves of their own (which of two equal leaves is first makes no difference); an empty text is
no null; a table with one row has its leaf as root and an empty proof; an empty table gives no rows;
texts count whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, partitions, shared_folder, written

#: Nodes in a run, and digits that are grouped away in a tier.
RUN, DIGITS = 16, 3
BLOCK = RUN**DIGITS
#: Rows of paths (about 4 kB each at most) and of counts that are broadcast.
BROADCAST_PATHS, BROADCAST_COUNTS = 4_000, 200_000
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(values: list[Column]) -> Column:
    """sha256 of the values, each as its count of UTF-8 bytes, a colon and the value, or a dash for null."""
    told = [F.concat(F.octet_length(s).cast("string"), F.lit(":"), s) for s in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in told]), 256)


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def ranked(nodes: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """nodes with rank, the place among those of equal key in the given order, and n, how many those are.

    Sorted by ranges; places are those in a range partition and the counts of the partitions before, so no key is in one task.
    """
    spark = nodes.sparkSession
    columns = nodes.columns
    by = ["key", *[F.asc_nulls_first(c) for c in order]]
    dealt = nodes.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), folder, f"{name}_sorted")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("part", "key").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "key", "first", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    counts = written(counts, folder, f"{name}_counts")  # a row for each key and partition that meet
    met = dealt.join(_small(counts, BROADCAST_COUNTS), ["part", "key"])
    return met.select(*columns, (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "n")


def _over(run: Column, at_least: int) -> Column:
    """The digest of a run's nodes while its group has more than one node left there, else the node itself."""
    nodes = run["node"]
    return F.when(F.col("n") > at_least, F.sha2(F.array_join(nodes, ""), 256)).otherwise(F.get(nodes, F.lit(0)))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, n, block, kids, node): blocks of (key, rank, n, node, held), nested three levels deep.

    One shuffle, by block: each grouping after it keeps its rows where they are.
    """
    digit = lambda k: F.shiftright("rank", 4 * k).bitwiseAND(RUN - 1).cast("int")
    made = nodes.select("key", "n", F.shiftright("rank", 4 * DIGITS).alias("block"), digit(2).alias("d2"), digit(1).alias("d1"), F.struct(digit(0).alias("d"), "node", "held").alias("kid"))
    keys, left = ["key", "n", "block"], ["d2", "d1"]
    made = made.repartition("key", "block")
    for level in range(DIGITS):
        made = made.groupBy(*keys, *left).agg(F.sort_array(F.collect_list("kid")).alias("kids"))  # sixteen at most
        made = made.withColumn("node", _over(F.col("kids"), RUN**level))
        if left:
            made = made.select(*keys, *left[:-1], F.struct(F.col(left[-1]).alias("d"), "node", "kids").alias("kid"))
            left = left[:-1]
    return made


def tiers_of(nodes: DataFrame, folder: str, name: str) -> list[DataFrame]:
    """Tables of rolled_up, each over the nodes that the one before left, until every key has one."""
    tiers: list[DataFrame] = []
    while True:
        tier = written(rolled_up(nodes), folder, f"{name}_{len(tiers)}")
        tiers.append(tier)
        if not tier.where(F.col("n") > BLOCK).limit(1).count():
            return tiers
        above = F.ceil(F.col("n") / BLOCK).cast("long")
        nodes = tier.select("key", F.col("block").alias("rank"), above.alias("n"), "node", F.lit(None).cast("string").alias("held"))


def handed_down(tier: DataFrame) -> DataFrame:
    """A row for each node under tier's blocks: key, rank, kid (node, held) and path, (at, nodes) of each run up to the end of tier's own path.

    A level is exploded after the digests of its run have been put aside, so what a row copies is a run and not a block.
    """
    keep = [c for c in tier.columns if c not in ("kids", "node", "path")]
    made = tier.select(*keep, "path", F.col("kids.node").alias("run2"), F.explode("kids").alias("kid2"))
    made = made.select(*keep, "path", "run2", F.col("kid2.d").alias("d2"), F.col("kid2.kids.node").alias("run1"), F.explode("kid2.kids").alias("kid1"))
    made = made.select(*keep, "path", "run2", "d2", "run1", F.col("kid1.d").alias("d1"), F.col("kid1.kids.node").alias("run0"), F.explode("kid1.kids").alias("kid"))
    run = lambda at, nodes, over: F.when(F.col("n") > over, F.struct(at.alias("at"), F.col(nodes).alias("nodes")))
    own = F.array_compact(F.array(run(F.col("kid.d"), "run0", 1), run(F.col("d1"), "run1", RUN), run(F.col("d2"), "run2", RUN**2)))
    rank = F.shiftleft("block", 4 * DIGITS) + F.shiftleft("d2", 8) + F.shiftleft("d1", 4) + F.col("kid.d")
    others = [c for c in keep if c not in ("n", "block", "key")]
    return made.select("key", rank.cast("long").alias("rank"), "kid", F.concat(own, "path").alias("path"), *others)


def with_paths(tiers: list[DataFrame], tops: DataFrame, folder: str, name: str) -> DataFrame:
    """The lowest tier's blocks with the path above each. tops: (key, path, ..) of each key's last node."""
    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k].join(_small(above.withColumnRenamed("rank", "block"), BROADCAST_PATHS), ["key", "block"])
        if k == 0:
            return tier
        above = written(handed_down(tier).drop("kid"), folder, f"{name}_paths_{k}")
    raise ValueError("no tiers")


def siblings(step: Column) -> Column:
    return F.array_join(F.filter(step["nodes"], lambda _, i: i != step["at"]), "")


def fold(node: Column, path: Column) -> Column:
    """The digest that node and the siblings on the path lead to."""

    def up(held: Column, step: Column) -> Column:
        before, after = F.slice(step["nodes"], F.lit(1), step["at"]), F.slice(step["nodes"], step["at"] + 2, F.lit(RUN))
        return F.sha2(F.concat(F.array_join(before, ""), held, F.array_join(after, "")), 256)

    return F.aggregate(path, node, up)


def manifest(df: DataFrame, leaf: Callable[[dict[str, Column]], Column] | None = None, tampered: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """Per row of df (documents' columns): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered gives the values that are checked against the manifest, from those that it was made of;
    without it, the same. A row is verified if its leaf as checked and its siblings lead to the root.
    """
    folder = shared_folder(df.sparkSession)
    columns = {c: F.col(c) for c in LEAF_COLUMNS}
    made = leaf or (lambda values: digest_of([values[c] for c in LEAF_COLUMNS]))
    own, seen = made(columns), made({**columns, **(tampered(columns) if tampered else {})})
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # in the order of sources' bytes, null first
    leaves = df.select(key.alias("key"), own.alias("node"), F.struct(F.col("doc_id").alias("doc_id"), seen.alias("seen")).alias("held"))
    leaves = leaves.withColumn("doc_id", F.col("held.doc_id"))
    tiers = tiers_of(ranked(leaves, ["doc_id", "node"], folder, "leaves").drop("doc_id"), folder, "tier")
    subroots = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("node"))
    subroots = subroots.withColumn("held", F.struct(F.col("source").alias("source"), F.col("node").alias("subroot")))
    source_tiers = tiers_of(ranked(subroots, ["source"], folder, "sources").drop("source"), folder, "source_tier")
    last = source_tiers[-1].select("node").first()
    root = last["node"] if last else None
    nothing = F.array().cast("array<struct<at: int, nodes: array<string>>>")
    top = source_tiers[-1].select("key", nothing.alias("path"))
    tops = handed_down(with_paths(source_tiers, top, folder, "source")).select(F.col("kid.held.source").alias("key"), F.col("kid.held.subroot").alias("subroot"), "path")
    tops = written(tops, folder, "tops")
    rows = handed_down(with_paths(tiers, tops, folder, "tier"))
    proof = F.sha2(F.array_join(F.transform("path", siblings), ""), 256)
    out = rows.select(F.col("kid.held.doc_id").alias("doc_id"), F.col("kid.node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), fold(F.col("kid.held.seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_fifth(values: dict[str, Column]) -> dict[str, Column]:
    """The tampering of the registered query: A-Z of texts in lower case where 5 divides the checksum of the id."""
    hit = F.crc32(values["doc_id"].cast("string")) % 5 == 0
    return {"text": F.when(hit, ascii_lower(values["text"])).otherwise(values["text"])}


def manifest_sql(levels: int = 5) -> str:
    """SQL of the registered query, for sources of up to 16 ** levels rows and as many sources."""
    field = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # DuckDB has no crc32: by bits of the polynomial, over the bytes of the decimal id
    bit = "list_reduce(list_prepend(x, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    parts = [
        f"bytes AS (SELECT x AS i, {bit} AS t FROM (SELECT unnest(range(0, 256)) AS x))",
        "crcs AS (SELECT map_from_entries(list(struct_pack(k := i, v := t))) AS m FROM bytes)",
        "d AS (SELECT *, row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS told FROM documents)",
        "e AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(told, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        "lambda c, b: xor(m[xor(c, b) & 255], c >> 8)), 4294967295) % 5 = 0 AS hit FROM d, crcs)",
        f"l AS (SELECT *, {leaf('text')} AS leaf, {leaf('seen')} AS seen_leaf FROM (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM e))",
        "a0 AS (SELECT r, coalesce('=' || source, '') AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM l)",
    ]

    def level(name: str, k: int) -> str:
        return f"{name}{k} AS (SELECT key, n, pos // 16 AS pos, CASE WHEN n > {16 ** (k - 1)} THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {name}{k - 1} GROUP BY key, n, pos // 16)"

    parts += [level("a", k) for k in range(1, levels + 1)]
    parts.append(f"b0 AS (SELECT '' AS key, key AS source, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, node FROM a{levels})")
    parts += [level("b", k) for k in range(1, levels + 1)]

    def siblings_of(name: str, own: str, key: str, at: str, n: str, k: int) -> str:
        near = f"{name}{k}.key = {key} AND {name}{k}.pos // 16 = {at} // {16 ** (k + 1)}"
        part = lambda side: f"coalesce((SELECT string_agg(node, '' ORDER BY pos) FROM {name}{k} WHERE {near} AND {name}{k}.pos {side} {at} // {16**k}), '')"
        return f"CASE WHEN {n} > {16**k} THEN {part('<')} ELSE '' END AS {own}{k}_before, CASE WHEN {n} > {16**k} THEN {part('>')} ELSE '' END AS {own}{k}_after"

    chosen = [siblings_of("a", "p", "x.key", "x.pos", "x.n", k) for k in range(levels)] + [siblings_of("b", "s", "''", "y.pos", "y.n", k) for k in range(levels)]
    parts.append(
        f"w AS (SELECT l.doc_id, l.leaf, l.seen_leaf, y.node AS subroot, z.node AS root, x.n AS an, y.n AS bn, {', '.join(chosen)} "
        f"FROM a0 x JOIN l ON l.r = x.r JOIN b0 y ON y.source = x.key, b{levels} z)"
    )
    steps = [("p", "an", k) for k in range(levels)] + [("s", "bn", k) for k in range(levels)]
    proof = " || ".join(f"{o}{k}_before || {o}{k}_after" for o, _, k in steps)
    parts.append(f"f0 AS (SELECT *, sha256({proof}) AS proof_sha256, seen_leaf AS folded FROM w)")
    for i, (o, n, k) in enumerate(steps):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {n} > {16**k} THEN sha256({o}{k}_before || folded || {o}{k}_after) ELSE folded END AS folded) FROM f{i})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}"
