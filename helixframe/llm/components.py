"""Connected components of a table of links, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written

ROUNDS = 60
#: Rows of two numbers up to which labels are broadcast.
BROADCAST_ROWS = 500_000


def components(links: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """links (a long, b long) -> (node, root): root is the smallest node reachable; only linked nodes appear.

    Each round takes every node to the smallest label among its own, its neighbours' and its label's
    label, so labels halve their way to the root. Sums are combined before each shuffle. A node with very
    many links, or a label that very many nodes have, is the key of many rows: tables of labels are
    broadcast up to a bound, so that such rows stay where they are, and beyond it the joins are plain, so
    that Spark can split them. Tables are written each round.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, folder, "links")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), folder, "labels_0")
    told = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    nodes = labels.count()
    for k in range(1, rounds + 1):
        of = told(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), nodes)
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        seen = labels.join(near, "node")
        # a label also hears what its followers see: roots hook onto smaller roots
        heard = seen.select(F.col("root").alias("node"), "near").groupBy("node").agg(F.min("near").alias("heard"))
        met = written(seen.join(heard, "node", "left").select("node", "root", F.least("root", "near", "heard").alias("new")), folder, f"met_{k}")
        jump = met
        if nodes > BROADCAST_ROWS:
            followed = met.select(F.col("new").alias("node")).distinct()  # only labels that some node has are looked up
            jump = written(met.join(followed, "node", "left_semi"), folder, f"jumps_{k}")
        jump = jump.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        out = met.join(told(jump, nodes if nodes <= BROADCAST_ROWS else jump.count()), "new", "left").select("node", F.least("new", "jump").alias("root"), (F.least("new", "jump") != F.col("root")).alias("changed"))
        out = written(out, folder, f"labels_{k}")
        labels = out.select("node", "root")
        if not out.where("changed").take(1):
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
