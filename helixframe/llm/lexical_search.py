"""Operator 11, ranked lexical search by presence masks.

All documents are read once: each becomes its length and the counts of those terms that queries
have. For a batch of documents and a query, bitmaps of its terms give each document the mask of
terms that it holds; documents of equal masks form a group. A mask's highest possible score is the
sum of its terms' highest ones, so groups are scored by descending bound until none that is left can
reach the lowest of the best documents found so far. A task carries its best documents from batch to
batch; those of all tasks meet in one last ranking.

Queries are dealt to blocks by their count of terms, and each block runs over all documents, so the
terms that a task holds are bounded whatever the number of queries.

Defined results: null texts have no terms; documents without terms count for nothing; each distinct
(id, text) of the queries is a query of its own, one without terms or matches gives no rows; repeated
documents each have a place; equal scores go by ascending id, a null id first, rows alike in both in
any order; empty tables give no rows; texts count whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, shared_folder, spread, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
BEST = 10
#: Terms of the queries of a block: what each task holds.
BLOCK_TERMS = 500_000
#: Terms of a query times documents that are looked at together.
CELLS = 8_000_000


def query_terms(items: DataFrame, folder: str, block_terms: int) -> tuple[DataFrame, int]:
    """(item_id, terms, query, block) of each distinct query that has terms, and the number of blocks."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({TERM})"), 1))
    queries = items.select("item_id", "text").distinct().select("item_id", terms.alias("terms")).where(F.size("terms") > 0)
    queries = written(queries.withColumn("query", F.monotonically_increasing_id()), folder, "queries")
    total = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // block_terms)
    return queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks)))), blocks


def index_terms(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): the length of each document with a term, and its counts of terms of the vocabulary."""
    places = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value
        find = re.compile(TERM).findall
        for batch in batches:
            kept, sizes, terms, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                found = find((text.as_py() or "").translate(UPPER_TO_LOWER))
                if not found:
                    continue
                own = {place[t]: c for t, c in Counter(found).items() if t in place}
                kept.append(i)
                sizes.append(len(found))
                terms += own.keys()
                counts += own.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(index, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def groups_of_masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks (groups x terms) of a bitmap (terms x documents), and each document's group."""
    bits = np.packbits(present, axis=0)
    bits = np.vstack([bits, np.zeros((-len(bits) % 8, bits.shape[1]), np.uint8)])
    words = np.ascontiguousarray(bits.T).view(np.uint64)
    group = np.zeros(len(words), np.int64)
    for column in words.T:  # refined by 64 terms at a time
        _, at = np.unique(column, return_inverse=True)
        _, group = np.unique(group * (at.max() + 1) + at, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    return present[:, first].T, group


def best_of(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~nulls, -scores))[:k]


class Ranking:
    """The best documents of each query among those seen so far."""

    def __init__(self, queries: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries = [(q, np.array(t, np.int64)) for q, t in queries]
        self.weights, self.n_docs, self.n_terms, self.k = weights, n_docs, n_terms, k
        none = np.zeros(0, np.int64)
        self.best = {q: (none, none, none.astype(bool)) for q, _ in queries}
        self.scored = 0  # documents whose scores were worked out, over all queries

    def add(self, ids: np.ndarray, nulls: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        length = 10 + (90 * n * self.n_docs) // self.n_terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        tf = counts.astype(np.int64)
        part = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
        order = np.argsort(terms, kind="stable")
        doc, part = doc[order], part[order]
        bounds = np.searchsorted(terms[order], np.arange(len(self.weights) + 1))
        highest = np.zeros(len(self.weights), np.int64)
        held = np.flatnonzero(np.diff(bounds))
        if len(held):
            highest[held] = np.maximum.reduceat(part, bounds[held])
        for query, own in self.queries:
            step = max(64, CELLS // len(own))
            for low in range(0, len(n), step):
                self._one(query, own, low, min(low + step, len(n)), ids, nulls, doc, part, bounds, highest)

    def _one(self, query: int, own: np.ndarray, low: int, high: int, ids: np.ndarray, nulls: np.ndarray, doc: np.ndarray, part: np.ndarray, bounds: np.ndarray, highest: np.ndarray) -> None:
        parts = np.zeros((len(own), high - low), np.int64)
        for i, t in enumerate(own):
            a, b = bounds[t], bounds[t + 1]
            a, b = (a, b) if high - low == len(ids) else a + np.searchsorted(doc[a:b], [low, high])
            parts[i, doc[a:b] - low] = part[a:b]
        masks, group = groups_of_masks(parts > 0)
        most = masks @ highest[own]
        by_bound = np.argsort(-most, kind="stable")
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(most) + 1))
        scores, found, null = self.best[query]
        at, block = 0, 16
        while at < len(by_bound):
            least = scores[-1] if len(scores) == self.k else 1
            chosen = by_bound[at : at + block]
            chosen = chosen[most[chosen] >= least]  # bounds fall, so the rest are below it as well
            if not len(chosen):
                break
            rows = np.concatenate([by_group[starts[g] : starts[g + 1]] for g in chosen])
            self.scored += len(rows)
            got = parts[:, rows].sum(0)
            rows, got = rows[got >= least], got[got >= least]
            scores, found, null = np.concatenate([scores, got]), np.concatenate([found, ids[low + rows]]), np.concatenate([null, nulls[low + rows]])
            top = best_of(scores, found, null, self.k)
            scores, found, null = scores[top], found[top], null[top]
            at, block = at + len(chosen), block * 2
        self.best[query] = scores, found, null


def best_documents(index: DataFrame, queries: list[tuple[int, list[int]]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best documents of each task."""
    told = index.sparkSession.sparkContext.broadcast((queries, np.array(weights, np.int64)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(*told.value, n_docs, n_terms, k)
        for b in batches:
            if b.num_rows:
                ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                nulls = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(bool)
                terms, counts = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                ranking.add(ids, nulls, b.column(1).to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), terms, counts)
        rows = [(q, None if z else int(i), int(s)) for q, (scores, ids, nulls) in ranking.best.items() for s, i, z in zip(scores, ids, nulls)]
        columns = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return index.mapInArrow(rank, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query, a row of items (item_id, text)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    queries, blocks = query_terms(items, folder, block_terms)
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    found = None
    for b in range(blocks):
        rows = [(r["query"], r["terms"]) for r in queries.where(F.col("block") == b).select("query", "terms").collect()]  # a block's terms at most
        vocabulary = sorted({t for _, terms in rows for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        index = written(index_terms(docs, vocabulary, id_col, text_col), folder, f"index_{b}")
        total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # a row for each term of the block
        holding = {r["term"]: r["n"] for r in held}
        weights = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(vocabulary))]
        part = best_documents(index, [(q, [place[t] for t in terms]) for q, terms in rows], weights, total["docs"], total["terms"] or 1, k)
        part = written(part, folder, f"best_{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0
), q AS (
  SELECT item_id, r AS query, unnest(list_distinct(words)) AS term FROM (
    SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL)
), t AS (
  SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d
), f AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
), g AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s
), p AS (
  SELECT query, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN g USING (term), s GROUP BY query, item_id, r, doc_id
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id ASC NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
