"""Operator 8, sharding by balanced label propagation, with DataFrame functions only.

Documents of equal text are linked. Every document starts in a shard by its hash; then, for a few
rounds, joins let the linked documents move towards the shards where most of their group is, within
a capacity per shard. Documents without links are ballast: after the rounds they, and what is over
a shard's size, level the sizes out. The law is `rows`: counts of shards are at most one apart.

A group that exceeds a shard's capacity aims for as many shards as it needs. Moves ask for room in
a matrix of shards by shards, which is all that reaches the driver; a share of each move is granted
by a hash of the group, so that parts of a group move together. Ranks come from a range-partitioned
sort and the counts of its partitions, so neither a shard nor a group is ever in one task.

Defined results: a null text is an empty one, so such rows are linked; null doc_ids sort first;
repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
Ties go to the smaller hash. Whole texts count, by digest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import partitions, shared_folder, written

SHARDS, ROUNDS = 40, 4
#: Rounds end once fewer than this share of the linked documents is granted a move.
STILL = 0.001
_ROW = (1 << 33) - 1


def grants(demand: np.ndarray, loads: np.ndarray, cap: float) -> np.ndarray:
    """The share of each wanted move (from, to) that keeps every load within the capacity."""
    granted = demand.astype(float)
    for _ in range(100):
        after = loads - granted.sum(1) + granted.sum(0)
        over = np.maximum(0, after - cap)
        inflow = granted.sum(0)
        if not (over > 1e-6 * max(cap, 1)).any():
            break
        granted *= np.where(inflow > 0, np.maximum(0, inflow - over) / np.maximum(inflow, 1e-12), 1)[None, :]
    return np.divide(granted, demand, out=np.zeros_like(granted), where=demand > 0)


def propagate(linked: DataFrame, shards: int, cap: float, rounds: int, folder: str) -> DataFrame:
    """Rows (row, grp, n, shard) after the rounds. linked: the same before."""
    spark = linked.sparkSession
    state = written(linked, folder, "state_0")
    for k in range(1, rounds + 1):
        per = state.groupBy("grp", "n", "shard").agg(F.count("*").alias("c"))
        order = F.struct((-F.col("c")).alias("c"), F.xxhash64("grp", "shard").alias("h"), F.col("shard"))
        best = per.groupBy("grp", "n").agg(F.sort_array(F.collect_list(order)).alias("best"))  # shards at most
        need = F.least(F.ceil(F.col("n") / F.lit(cap)), F.size("best")).cast("int")
        best = written(best.select("grp", F.slice("best.shard", F.lit(1), need).alias("best")), folder, f"best_{k}")
        wish = state.join(best, "grp")
        aim = F.element_at("best", (F.pmod(F.xxhash64("row"), F.size("best")) + 1).cast("int"))
        wish = wish.withColumn("to", F.when(F.array_contains("best", F.col("shard")), F.col("shard")).otherwise(aim)).drop("best")
        wish = written(wish, folder, f"wish_{k}")
        flows = wish.groupBy("shard", "to").agg(F.count("*").alias("c")).collect()  # shards x shards rows at most
        demand, loads = np.zeros((shards, shards)), np.zeros(shards)
        for r in flows:
            loads[r["shard"]] += r["c"]
            if r["shard"] != r["to"]:
                demand[r["shard"], r["to"]] = r["c"]
        share = grants(demand, loads, cap)
        moved = float((share * demand).sum())
        if moved < max(1.0, STILL * loads.sum()):
            break
        rows = [(i, j, float(share[i, j])) for i, j in zip(*np.nonzero(demand))]
        granted = F.broadcast(spark.createDataFrame([(int(i), int(j), s) for i, j, s in rows], "shard int, to int, share double"))
        roll = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1_000_000)) / 1e6
        state = wish.join(granted, ["shard", "to"], "left").select("row", "grp", "n", F.when(roll < F.col("share"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        state = written(state, folder, f"state_{k}")
    return state


def level(placed: DataFrame, shards: int, total: int, folder: str) -> DataFrame:
    """placed (doc_id, size, text_crc32, row, alone, grp, shard) with even counts and gapless slots.

    In each shard linked groups come first, so what is over its size are documents without links as
    long as there are any; they fill the shards that lack rows, in order.
    """
    spark = placed.sparkSession
    order = ["shard", "alone", "grp", F.asc_nulls_first("doc_id"), "row"]
    dealt = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranked = written(dealt.select("doc_id", "size", "text_crc32", "shard", at.alias("at")), folder, "ranked")
    ranked = ranked.withColumns({"part": F.shiftright("at", 33).cast("int"), "at": F.col("at").bitwiseAND(F.lit(_ROW))})
    # a range partition holds few shards: as many rows as partitions and shards together
    starts, counts = [], np.zeros(shards, int)
    for r in ranked.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part", "shard").collect():
        starts.append((r["part"], r["shard"], int(counts[r["shard"]]) - r["first"]))
        counts[r["shard"]] += r["n"]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = np.concatenate([[0], np.cumsum(np.maximum(0, counts - quota))])
    ranked = ranked.join(F.broadcast(spark.createDataFrame(starts, "part int, shard int, base long")), ["part", "shard"])
    ranked = ranked.withColumn("slot", F.col("base") + F.col("at"))
    sizes = [(s, int(quota[s]), int(over[s])) for s in range(shards)]
    ranked = ranked.join(F.broadcast(spark.createDataFrame(sizes, "shard int, quota long, before long")), "shard")
    spare = F.col("before") + F.col("slot") - F.col("quota")
    to, slot, filled = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    lacking = [(s, int(quota[s] - counts[s])) for s in range(shards) if counts[s] < quota[s]]
    ends = np.cumsum([n for _, n in lacking]).tolist()
    for (s, n), end in reversed(list(zip(lacking, ends))):
        to = F.when(spare < end, s).otherwise(to)
        slot = F.when(spare < end, int(counts[s]) + spare - (end - n)).otherwise(slot)
    kept = F.col("slot") < F.col("quota")
    return ranked.select("doc_id", "size", "text_crc32", F.when(kept, F.col("shard")).otherwise(to).cast("int").alias("shard"), F.when(kept, F.col("slot")).otherwise(slot).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    folder = shared_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("grp"), F.monotonically_increasing_id().alias("row"),
    )
    first = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")
    base = written(base.withColumn("shard", first), folder, "base")
    total = base.count()
    # tables of their own, so that Spark can split the joins of a hot group
    groups = written(base.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), folder, "groups")
    linked = base.join(groups, "grp").select("row", "grp", "n", "shard")
    moved = propagate(linked, shards, max(1.0, total / shards), rounds, folder)
    placed = base.join(moved.select("row", F.col("shard").alias("to")), "row", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "row", F.col("to").isNull().alias("alone"), "grp", F.coalesce("to", "shard").alias("shard"))
    done = level(placed, shards, total, folder)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
