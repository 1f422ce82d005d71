"""Operator 4, mixing to target weights by soft membership.

A classifier fitted on the labels table gives each document a posterior over domains (poor, good,
toxic). Nonnegative rates per document are then fitted by least squares so that the expected tokens
of each domain, the sum of rate x tokens x posterior, meet their targets.

The fit is a projected gradient step taken implicitly: the rates are the projection, onto rates of zero
and more, of the starting rates of one minus a step along the gradient at the new rates themselves. An
explicit step must be short, and where targets cannot be reached takes thousands of passes; an implicit
one descends whatever its length. In the metric that weighs a document by its tokens the gradient at a
document is its posterior times the error of the domains, so the step is found by solving for three
numbers: each Newton iteration is one distributed sum over all documents, which also tries shorter
iterations. The step is lengthened until the error is close to nothing or to its lower bound, which
follows from the least gradient of all documents; if that does not come, a warning says so and
`optimal` is false. Targets that no mixture of the documents has are met as near as can be, and the
attained shares are reported.

A document's rate is realised as whole copies plus one more by a hash that is uniform in its fraction.

Defined results: null text has no tokens and takes no part in the sums, its posterior is the
classifier's for an empty text; very long texts count with all their tokens; rows with equal
posteriors have equal rates, so ties and repeated rows are rated alike, and repeated rows count as
often as they occur; without usable labels, or with one label class only, there is one domain; an
empty table gives no rows. Whole texts are read; extra columns are ignored by the report and kept by
the mixture. Labels of unknown documents and null labels are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import WHITE, fresh, shared_folder, written

#: Domains in the order of the classifier's classes, and the share of all tokens each should have.
DOMAINS = ("poor", "good", "toxic")
TARGETS = {"poor": 0.12, "good": 0.85, "toxic": 0.03}
#: Labelled documents that the classifier is fitted on at most (on average, chosen by a hash of the
#: doc_id), and how many of a rare class there are among them if it has so many.
MOST_LABELLED, OF_A_CLASS = 20_000, 1_000
FEATURES = 1 << 15
#: Passes over the documents at most; the error of a domain's share, and of half the squared distance
#: over its lower bound, that end the fit; length of the first step, and its growth.
PASSES, CLOSE, GAP, FIRST, GROWTH = 80, 1e-4, 1e-7, 100.0, 10.0
#: Parts of a Newton iteration that are tried in one pass.
TRIALS = (1.0, 0.4, 0.05)
#: A fall of the dual, relative to it, that is no longer told from rounding; the least part of an iteration that is tried.
PRECISION, LEAST_PART = 1e-15, 1e-9


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE + "+"), lambda w: w != "")


def features(df: DataFrame, text_col: str, words: str, vector: str) -> DataFrame:
    """df with its words and their hashed counts, as presence of each word."""
    return HashingTF(inputCol=words, outputCol=vector, numFeatures=FEATURES, binary=True).transform(df.withColumn(words, words_of(F.col(text_col))))


def sampled_labels(labels: DataFrame, most_labelled: int) -> DataFrame:
    """(labelled, label, weight): usable labels, thinned by a hash of the id; a rare class is thinned less and weighs less."""
    domain = F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.0)
    known = labels.select(F.col("doc_id").alias("labelled"), domain.alias("label")).where("labelled is not null and label is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # three rows
    share = min(1.0, most_labelled / max(1, sum(counts.values())))
    kept, weight = F.lit(0.0), F.lit(1.0)
    for label, n in counts.items():
        own = max(share, min(1.0, OF_A_CLASS / n))
        kept, weight = F.when(F.col("label") == label, own).otherwise(kept), F.when(F.col("label") == label, share / own).otherwise(weight)
    roll = F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) / 1e6
    return known.where(roll < kept).withColumn("weight", weight)


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED):
    """A multinomial logistic regression over the domains, or None if the labels show fewer than two.

    The thinned labels are few, so they are broadcast (their count is checked) and texts are scanned once.
    """
    folder = shared_folder(docs.sparkSession)
    some = written(sampled_labels(labels, most_labelled), folder, "sampled_labels")
    some = F.broadcast(some) if some.count() <= 2 * (most_labelled + len(DOMAINS) * OF_A_CLASS) else some
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text")).where("text is not null")
    rows = written(texts.join(some, "labelled").select("text", "label", "weight"), folder, "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = features(rows, "text", "words", "vector").select("label", "weight", "vector")
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", maxIter=25, regParam=0.01, standardization=False).fit(vectors)


def scored(docs: DataFrame, model, text_col: str, tokens: str, posterior: str) -> DataFrame:
    """docs with the count of tokens and the posterior array over DOMAINS."""
    words, vector = fresh(docs, "words"), fresh(docs, "vector")
    if model is None:
        one = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
        return docs.withColumns({tokens: F.size(words_of(F.col(text_col))).cast("long"), posterior: one})
    raw, predicted = fresh(docs, "raw"), fresh(docs, "predicted")
    names = [f"`{c}`" for c in docs.columns]
    model = model.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(posterior).setPredictionCol(predicted)
    said = model.transform(features(docs, text_col, words, vector))
    short = F.slice(F.concat(vector_to_array(posterior), F.array_repeat(F.lit(0.0), len(DOMAINS))), 1, len(DOMAINS))
    return said.select(*names, F.size(words).cast("long").alias(tokens), short.alias(posterior))


@dataclass
class Fit:
    """What the fit attained. `slope` gives any document's rate from its posterior."""

    slope: list[float]  # the step's length times the error of each domain
    shares: dict[str, float]  # expected tokens of each domain over all tokens of the input
    error: float  # the distance of the shares from the targets
    optimal: bool  # whether it is certain that no rates come nearer
    passes: int

    def rate(self, posterior: str) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - _form(posterior, self.slope))


def _form(posterior: str, by) -> Column:
    terms = [F.col(posterior)[i] * F.lit(float(b)) for i, b in enumerate(by)]
    return sum(terms[1:], terms[0])


def fit_rates(rows: DataFrame, tokens: str, posterior: str, targets: dict[str, float], passes: int = PASSES, close: float = CLOSE, gap: float = GAP) -> Fit:
    """Fits the rates of rows (counted tokens and posteriors), which each pass reads once. Only sums reach the driver."""
    k = len(DOMAINS)
    goal = np.array([float(targets[d]) for d in DOMAINS]) / sum(targets.values())
    state = rows.select(F.col(tokens).cast("double").alias("t"), F.col(posterior).alias("p")).where("t > 0 and p is not null")
    used = 0

    def sums(candidates: list[np.ndarray], length: float, error: np.ndarray | None = None) -> tuple[list[dict], float]:
        """For each candidate of the error: the dual objective, shares and Gram matrix of the rates; the least gradient for an error."""
        nonlocal used
        used += 1
        each = state.select("t", "p", *[F.greatest(F.lit(0.0), F.lit(1.0) - _form("p", length * e)).alias(f"r{c}") for c, e in enumerate(candidates)])
        aggs = [F.sum("t").alias("t"), F.min(_form("p", np.zeros(k) if error is None else error)).alias("least")]
        for c in range(len(candidates)):
            r, live = F.col(f"r{c}"), F.when(F.col(f"r{c}") > 0, F.col("t")).otherwise(F.lit(0.0))
            aggs += [F.sum(F.col("t") * r * r).alias(f"q{c}")] + [F.sum(F.col("t") * r * F.col("p")[i]).alias(f"a{c}_{i}") for i in range(k)]
            aggs += [F.sum(live * F.col("p")[i] * F.col("p")[j]).alias(f"g{c}_{i}{j}") for i in range(k) for j in range(i + 1)]
        got = each.agg(*aggs).first()
        if not got["t"]:
            return [], 0.0
        out = []
        for c, e in enumerate(candidates):
            shares = np.array([got[f"a{c}_{i}"] for i in range(k)]) / got["t"]
            gram = np.array([[got[f"g{c}_{max(i, j)}{min(i, j)}"] for j in range(k)] for i in range(k)]) / got["t"]
            out.append({"e": e, "dual": 0.5 * e @ e + goal @ e + got[f"q{c}"] / got["t"] / (2 * length), "shares": shares, "gram": gram})
        return out, got["least"]

    length = FIRST
    now, _ = sums([np.zeros(k)], length)
    if not now:
        return Fit([0.0] * k, dict.fromkeys(DOMAINS, 0.0), float(np.linalg.norm(goal)), True, used)
    now, best, optimal = now[0], None, False
    while True:
        while used < passes:  # the error that is its own consequence at this length
            off = now["e"] + goal - now["shares"]
            if np.abs(off).max() <= 0.1 * close:
                break
            turn = np.linalg.solve(np.eye(k) + length * now["gram"], off)
            if off @ turn <= PRECISION * max(1.0, abs(now["dual"])):
                break  # what the step promises is below the numbers' precision
            least, part = now, 1.0
            while used < passes and least is now and part > LEAST_PART:  # the turn leads downwards, if by small enough a part of it
                tried, _ = sums([now["e"] - part * x * turn for x in TRIALS], length)
                best_tried = min(tried, key=lambda x: x["dual"])
                least, part = best_tried if best_tried["dual"] < now["dual"] else now, part * TRIALS[-1]
            if least is now:
                break
            now = least
        error = now["shares"] - goal
        if best is None or error @ error < best[0] @ best[0]:
            best = (error, length * now["e"], now["shares"])
        if np.abs(error).max() < close:
            optimal = True
            break
        e, last = now["e"], length
        length *= GROWTH
        starts, least = sums([e, e * last / length], length, error)  # the same error, or the same rates
        now = min(starts, key=lambda x: x["dual"])
        # a y whose product with no posterior is negative bounds the objective from below
        y = error + max(0.0, -least)
        bound = max(0.0, -(y @ goal)) ** 2 / max(2 * (y @ y), 1e-300)
        if 0.5 * error @ error - bound < gap:
            optimal = True
            break
        if used >= passes or last > 1e14:
            break
    error, slope, shares = best
    if not optimal:
        warnings.warn(f"mixing rates are not proved optimal: shares {shares.round(5).tolist()} for targets {goal.round(5).tolist()}", stacklevel=2)
    return Fit([float(x) for x in slope], dict(zip(DOMAINS, map(float, shares))), float(np.linalg.norm(error)), optimal, used)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, p_poor, p_good, p_toxic, rate, copies, and the attained share_poor, share_good, share_toxic and optimal."""
    folder = shared_folder(docs.sparkSession)
    model = fit_domains(docs, labels, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scored(base, model, "text", "n_tokens", "posterior").withColumn("roll", roll("doc_id", "text")).drop("text")
    rows = written(rows, folder, "scored")
    fit = fit_rates(rows, "n_tokens", "posterior", targets or TARGETS)
    attained = [F.lit(fit.shares[d]).alias(f"share_{d}") for d in DOMAINS]
    return rows.withColumn("rate", fit.rate("posterior")).select(
        "doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("roll")).alias("copies"), *attained, F.lit(fit.optimal).alias("optimal")
    )


def roll(id_col: str, text_col: str) -> Column:
    """A number from 0 to 1 that the id and the text decide."""
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_003)) / 1_000_003.0


def copies(rate: Column, rolled: Column) -> Column:
    return (F.floor(rate) + (rolled < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as a mixture: each row as often as its copies say; all columns are kept."""
    folder = shared_folder(docs.sparkSession)
    model = fit_domains(docs, labels, id_col, text_col)
    tokens, posterior, n = (fresh(docs, x) for x in ("tokens", "posterior", "copies"))
    rows = written(scored(docs, model, text_col, tokens, posterior), folder, "scored")
    fit = fit_rates(rows.select(tokens, posterior), tokens, posterior, targets or TARGETS)
    dealt = rows.withColumn(n, copies(fit.rate(posterior), roll(id_col, text_col))).where(F.col(n) > 0)
    return dealt.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias(n)).drop(n)
