"""Operator 6, language identification by n-gram filters with a language bit mask.

Training counts, per language, the documents that hold each character n-gram, and keeps n-grams in
at least a share of them. They fill one Bloom filter per language, all with the same hash functions,
stored bit-sliced: slot i holds a word whose bit L says that language L's filter has bit i set. One
lookup, the AND of a few words, so returns all languages that hold an n-gram. Per text and language
the set bits are counted, what a filter of that fill would report by chance is taken off, and the
largest remainder decides.

Defined results: `und` with score 0 for a null text or one without letters; ties go to the language
that comes first in the sorted list; without any training row every text is `und`. Each input row
gives one row, nulls and repeats included. Whole texts are read; extra columns are ignored by the
report and kept by the filter. Training reads only text and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, partitions

NGRAM, SLOTS, HASHES = 4, 1 << 20, 3
#: Documents of a language that training reads at most (chosen by a hash of their text), and the
#: share of them that must hold an n-gram.
MOST_DOCS, LEAST_SHARE = 5_000, 0.05
#: Code points handled at once, and texts taken from Arrow at once.
PIECE, ROWS = 1 << 17, 64
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each n-gram of letters and single boundaries in each text."""
    parts = [" " + t + " " * (NGRAM - 1) if t else "" for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    points = letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
    doc = np.repeat(np.arange(len(parts)), sizes)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == SPACE) & (points[:-1] == SPACE) & (doc[1:] == doc[:-1])
    points, doc = points[~again], doc[~again]  # boundaries are one character wide
    n = len(points) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + points[k : n + k].astype(np.uint64))
    whole = doc[:n] == doc[NGRAM - 1 :]
    return doc[:n][whole], h[whole]


def slots(h: np.ndarray, m: int, hashes: int) -> list[np.ndarray]:
    """Places of each hash in the filters, by double hashing."""
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(k) * two) % np.uint64(m)).astype(np.int64) for k in range(hashes)]


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)
    hashes: int = HASHES

    def chance(self) -> np.ndarray:
        """The false positive rate of each language's filter: its fill to the power of the hash functions."""
        return self._chance

    @cached_property
    def _chance(self) -> np.ndarray:
        fill = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share of the corrected counts) of each text."""
        n, names, chance = len(texts), self.languages, self.chance() if self.languages else np.zeros(0)
        counts, total = np.zeros((n, len(names))), np.zeros(n)
        at = 0
        while at < n:  # pieces of bounded size; one text is never cut
            end, size = at, 0
            while end < n and (end == at or size + len(texts[end] or "") <= PIECE):
                size, end = size + len(texts[end] or ""), end + 1
            doc, h = grams(texts[at:end])
            total[at:end] = np.bincount(doc, minlength=end - at)
            found = None
            for place in slots(h, len(self.masks), self.hashes):
                found = self.masks[place] if found is None else found & self.masks[place]
            for i in range(len(names)):
                held = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                counts[at:end, i] = np.bincount(doc[held], minlength=end - at)
            at = end
        if not names:
            return ["und"] * n, np.zeros(n)
        letters_in = np.array([any(c.isalpha() for c in t) if t else False for t in texts], bool)
        corrected = np.maximum(0, counts - total[:, None] * chance) / (1 - np.minimum(chance, 0.999999))
        best, every = corrected.argmax(1), corrected.sum(1)
        score = np.divide(corrected[np.arange(n), best], every, out=np.full(n, 1 / len(names)), where=every > 0)
        said = [names[b] if ok else "und" for b, ok in zip(best, letters_in)]
        return said, np.where(letters_in, score, 0.0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS, least_share: float = LEAST_SHARE, m: int = SLOTS, hashes: int = HASHES) -> LanguageFilters:
    """Filters from labelled rows; the sample per language is bounded by most_docs, on average.

    What reaches the driver has one row for each slot at most.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    names = sorted(counts)
    if not names:
        return LanguageFilters([], np.zeros((m, 1), np.uint64), hashes)
    shares = spark.createDataFrame([(x, i, min(1.0, most_docs / counts[x])) for i, x in enumerate(names)], "lang string, bit int, share double")
    roll = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    sample = rows.join(F.broadcast(shares), "lang").where(roll < F.col("share")).select("bit", "text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column(0))
            for at in range(0, batch.num_rows, ROWS):
                doc, h = grams(batch.column(1).slice(at, ROWS).to_pylist())
                pairs = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0)  # a document counts once
                of, n = np.unique(np.stack([bits[at : at + ROWS][pairs[:, 0].astype(int)].astype(np.uint64), pairs[:, 1]], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of[:, 0].astype(np.int32)), pa.array(of[:, 1].copy().view(np.int64)), pa.array(n)], names=["bit", "gram", "n"])

    found = sample.repartition(partitions(spark)).mapInArrow(held, "bit int, gram long, n long").groupBy("bit", "gram").agg(F.sum("n").alias("n"))
    taken = sample.groupBy("bit").agg(F.count("*").alias("docs"))
    kept = found.join(F.broadcast(taken), "bit").where(F.col("n") >= F.greatest(F.lit(2), F.col("docs") * least_share)).select("bit", "gram")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(1)).view(np.uint64)
            for place in slots(h, m, hashes):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place.astype(np.int32))], names=["bit", "slot"])

    word = F.floor(F.col("bit") / 64).cast("int")
    filled = kept.mapInArrow(placed, "bit int, slot int").groupBy("slot", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))
    masks = np.zeros((m, (len(names) + 63) // 64), np.uint64)
    got = filled.toArrow()
    masks[np.asarray(got["slot"]), np.asarray(got["word"])] = np.asarray(got["mask"]).view(np.uint64)
    return LanguageFilters(names, masks, hashes)


def held_out(id_col: str = "doc_id"):
    """Documents that training never reads: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def predictor(spark: SparkSession, filters: LanguageFilters):
    """An Arrow UDF text -> struct(lang, score). The filters are of fixed size and broadcast once."""
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("lang string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            lang, score = [], [np.zeros(0)]
            for at in range(0, len(texts), ROWS):  # few texts at once are Python's
                names, shares = shared.value.predict(texts.slice(at, ROWS).to_pylist())
                lang += names
                score.append(shares)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["lang", "score"])

    return predict


def identify_languages(df: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    said = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predictor(df.sparkSession, filters)(F.col(text_col)).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_languages(df: DataFrame, filters: LanguageFilters, text_col: str = "text", least_score: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """df without rows whose language cannot be told (und, or all languages equally likely), scores under least_score, or languages not asked for."""
    p = fresh(df, "lang")
    said = df.withColumn(p, predictor(df.sparkSession, filters)(F.col(text_col)))
    n = len(filters.languages)
    even = 1 / n + 1e-9 if n > 1 else 0.0  # the score of a text without any known n-gram
    ok = (F.col(f"{p}.lang") != "und") & (F.col(f"{p}.score") >= max(least_score, even))
    return said.where(ok & F.col(f"{p}.lang").isin(languages) if languages else ok).drop(p)
