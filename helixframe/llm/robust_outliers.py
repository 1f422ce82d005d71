"""Operator 3, quality rules by robust multivariate outliers, with DataFrame functions only.

Plain rules come first: too few words, or too many words in repeated five-word windows. Every other
document has a vector of transformed statistics. Per language and source, a minimum-covariance-
determinant estimate is found by concentration steps: distances from the current centre and scatter,
the share of the rows that lie nearest, centre and scatter of these, and again until the determinants
settle, from two starts of which the one of the smaller determinant goes on. The scatter is made
consistent for normal data, and a document is rejected by its Mahalanobis distance beyond a quantile
of the chi-square distribution.

One rule holds for groups of all sizes: each language counts PRIOR rows of all documents' nearest
besides its own, and each source PRIOR rows of its language's. So a small group leans on its language,
and a large one hardly does.

Counts that are mostly zero have no scatter of their own. Symbols, repeated lines and repeated windows
are therefore taken as residuals: as a geometric count, whose mean is in proportion to the text's length
(to its power 1.5 for what repeats within it, as pairs of places do) and fits the share of documents
that have any, a count has an exponentially distributed value once it is spread within its step by a
hash of the text; the cube root of that is close to normal. The length of words is taken by its
deviation from the language's median in units of what so many words vary by.

All sums are combined before they are shuffled. Each step reads the vectors once: sums per group and bin
of distance give the nearest rows' sums by adding bins up, and are exact sums of all rows.

Defined results: null text has no words and fails the plain rules; each input row gives one row;
null language or source is a group like any other; an empty table gives no rows; one of few rows
is judged by the same rule, with a fixed scatter that counts TOP_PRIOR rows; extra columns are ignored.
Whole texts count, very long ones too. Equal texts of one group have equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import WHITE, shared_folder, written

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Share of the rows in the nearest subset, and what their covariance is short of for normal data of five
#: dimensions: the share over the chi-square probability, with seven degrees of freedom, of its quantile.
NEAREST, CONSISTENT = 0.75, 1.41207
#: Chi-square with five degrees of freedom: the cutoff of one in a million.
CUTOFF = 35.888
#: Rows of the group above that each group counts; rows of unit variance that all documents together count.
PRIOR, TOP_PRIOR = 50.0, 6.0
#: Steps from both starts, and then at most from the better one; a group has settled when its log-determinant moves by less.
STEPS_FIRST, STEPS_LAST, SETTLED = 2, 12, 0.001
#: Power of the length that repeats grow with; words whose lengths vary as much within a text as between texts; power of the count of words.
GROWTH, EVEN_WORDS, LENGTH_POWER = 1.5, 100.0, -0.05
#: Standard deviation added to each statistic's own, so that constant statistics have one: a hundredth.
ROUNDING = 0.01
DIMS = 5
X = [f"x{i}" for i in range(DIMS)]
SUMS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i in range(DIMS) for j in range(i + 1)]]
#: Bins of a distance: so many to a factor of e.
BINS = 32
#: Groups up to which their parameters are broadcast (30 numbers each).
BROADCAST_GROUPS = 20_000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of five whose words occur there again, by hashes of 64 bits."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    pair = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(pair, F.slice(pair, F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice(hashes, F.lit(5), F.greatest(n - 4, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.slice(five, F.lit(1), F.greatest(n - window + 1, F.lit(0)))


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One row for each document with the plain statistics and the group's columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"),
        F.filter(F.split(text, WHITE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.xxhash64(text).alias("roll"),
    )
    split = split.select(
        "doc_id", "lang", "source", "roll", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), repeated_words(F.col("words")).alias("windows"),
    )
    rest = [c for c in split.columns if c != "windows"]
    found = split.select(*rest, "windows", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("again"))
    # only texts that repeat a window are sorted: neighbours of equal hash give the windows' places
    placed = F.when(F.col("again"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    found = found.select(*rest, placed.alias("placed"))
    n = F.size("placed")
    after = F.slice("placed", F.lit(2), n)
    before = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))), F.slice("placed", F.lit(1), F.greatest(n - 1, F.lit(0))))
    twice = F.zip_with(F.zip_with("placed", after, lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), (a["h"] == b["h"]).alias("next"))), before, lambda a, b: F.when(a["next"] | (a["h"] == b["h"]), a["i"]))
    found = found.select(*rest, F.sort_array(F.filter(twice, lambda i: i.isNotNull())).alias("places"))
    gaps = F.zip_with("places", F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.coalesce(F.aggregate(gaps, F.lit(0), lambda held, x: held + x), F.lit(0))
    found = found.select(*rest, total.alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words").cast("long") > MOST_REPEATED * F.col("n_words").cast("long"))
    return found.withColumn("base_failed", failed)


def keyed(stats: DataFrame) -> DataFrame:
    """stats with the names of the language's group and of the group of both, which are never null."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return stats.withColumns({"by_lang": said("lang"), "key": F.concat(said("lang"), F.lit("\x01"), said("source"))})


def counts_with_lengths() -> dict[str, tuple[Column, Column]]:
    """Counts that are mostly zero, with the length that they grow with."""
    length = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return {
        "x2": (F.col("n_symbols").cast("double"), length("word_chars")),
        "x3": (F.col("n_dup_lines").cast("double"), F.pow(length("n_lines"), F.lit(GROWTH))),
        "x4": (F.ceil(F.col("n_repeat_words") / (2 * WINDOW)).cast("double"), F.pow(length("n_words"), F.lit(GROWTH))),
    }


def log_word_length() -> Column:
    return F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))


def vectors(rows: DataFrame, folder: str) -> DataFrame:
    """rows (keyed statistics) with the vector x0.., null where the plain rules fail."""
    ok, counted = rows.where("not base_failed"), counts_with_lengths()
    any_ = [F.sum((c > 0).cast("double")).alias(f"any_{x}") for x, (c, _) in counted.items()]
    size = [F.sum(w).alias(f"size_{x}") for x, (_, w) in counted.items()]
    own = ok.groupBy("by_lang", "key").agg(F.count("*").cast("double").alias("n"), *any_, *size)
    own = written(own, folder, "group_counts")
    names = [c for c in own.columns if c not in ("by_lang", "key")]
    lang = own.groupBy("by_lang").agg(*[F.sum(c).alias(f"l_{c}") for c in names])
    middle = ok.groupBy("by_lang").agg(F.percentile_approx(log_word_length(), 0.5, 10_000).alias("middle"))
    both = own.join(lang.join(middle, "by_lang"), "by_lang")
    for x in counted:
        share = (F.col(f"any_{x}") + PRIOR * (F.col(f"l_any_{x}") + 0.5) / (F.col("l_n") + 1)) / (F.col("n") + PRIOR)
        mean = (F.col(f"size_{x}") + PRIOR * F.col(f"l_size_{x}") / F.col("l_n")) / (F.col("n") + PRIOR)
        both = both.withColumn(f"rate_{x}", F.least(share, F.lit(0.999)) / (1 - F.least(share, F.lit(0.999))) / mean)
    rates = written(both.select("key", "middle", *[f"rate_{x}" for x in counted]), folder, "rates")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_GROUPS else rates
    met = rows.join(rates, "key", "left")
    n = F.col("n_words").cast("double")
    said = {"x0": F.pow(n, F.lit(LENGTH_POWER)) / -LENGTH_POWER, "x1": (log_word_length() - F.col("middle")) * F.sqrt(n / (1 + n / EVEN_WORDS))}
    for k, (x, (count, size_)) in enumerate(counted.items()):
        mean = F.col(f"rate_{x}") * size_
        more = mean / (1 + mean)  # the chance of one more
        spread = (F.pmod(F.xxhash64("roll", F.lit(k)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
        said[x] = F.cbrt(-count * F.log(more) - F.log(1 - spread * (1 - more)))
    return met.withColumns({x: F.when(~F.col("base_failed"), c).cast("double") for x, c in said.items()}).drop("middle", *[f"rate_{x}" for x in counted])


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
#: SQL texts, so that a step of the estimate is a few calls to the driver's JVM, not thousands.
ADDED_UP = ["cast(count(*) AS double) AS n", *[f"sum({x}) AS s{i}" for i, x in enumerate(X)], *[f"sum({X[i]} * {X[j]}) AS p{i}{j}" for i, j in PAIRS]]
PARAMS = [*[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS]]


def aggregated(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.expr(x) for x in sums])


def scatter(sums: DataFrame) -> DataFrame:
    """Per key and start the mean m0.., and the Cholesky factor l00, l10, l11.. of the consistent covariance.

    sums: by_lang, key, start and SUMS of the nearest rows; a row for each group.
    """
    names = ["by_lang", "key", "start", *[c for c in sums.columns if c == "was"]]
    every = aggregated(sums, ["start"], [f"sum({c}) AS a_{c}" for c in SUMS])
    mean = [f"(a_s{i} / a_n)" for i in range(DIMS)]  # a fixed scatter around the mean of all: without weight but in small tables
    held = [f"a_p{i}{j} + {TOP_PRIOR}D * ({mean[i]} * {mean[j]} + {1.0 if i == j else 0.0}D) AS b_p{i}{j}" for i, j in PAIRS]
    every = every.selectExpr("start", f"a_n + {TOP_PRIOR}D AS b_n", *[f"a_s{i} + {TOP_PRIOR}D * {mean[i]} AS b_s{i}" for i in range(DIMS)], *held)
    lang = sums.selectExpr("*", *[f"sum({c}) OVER (PARTITION BY by_lang, start) AS l_{c}" for c in SUMS])  # a row for each group of a language
    out = lang.join(F.broadcast(every), "start").selectExpr("*", *[f"l_{c} + {PRIOR}D * b_{c} / b_n AS k_{c}" for c in SUMS])
    out = out.selectExpr(*names, *[f"{c} + {PRIOR}D * k_{c} / k_n AS t_{c}" for c in SUMS])
    out = out.selectExpr(*names, *[f"t_s{i} / t_n AS m{i}" for i in range(DIMS)], *[f"t_p{i}{j} / t_n AS q{i}{j}" for i, j in PAIRS])
    for j in range(DIMS):  # a column of the factor: first its diagonal, then what is below

        def rest(i: int, j: int = j) -> str:
            cov = f"(q{i}{j} - m{i} * m{j}) * {CONSISTENT}D"
            return " - ".join([f"(greatest({cov}, 0.0D) + {ROUNDING**2}D)" if i == j else cov, *[f"l{i}{k} * l{j}{k}" for k in range(j)]])

        out = out.selectExpr("*", f"sqrt(greatest({rest(j)}, {ROUNDING**2 / 100}D)) AS l{j}{j}")
        if j + 1 < DIMS:
            out = out.selectExpr("*", *[f"({rest(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIMS)])
    return out.selectExpr(*names, *PARAMS, " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS)) + " AS log_det")


def distance(rows: DataFrame) -> DataFrame:
    """rows with m.. and l.. get the squared Mahalanobis distance `d2`."""
    for i in range(DIMS):
        rows = rows.selectExpr("*", f"({' - '.join([f'({X[i]} - m{i})', *[f'l{i}{k} * z{k}' for k in range(i)]])}) / l{i}{i} AS z{i}")
    return rows.selectExpr("*", " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + " AS d2").drop(*[f"z{i}" for i in range(DIMS)])


def nearest_sums(near: DataFrame, params: DataFrame) -> DataFrame:
    """SUMS of the nearest rows per group and start, of all bins up to the first one that completes their share; and `was`, the log-determinant of params."""
    away = distance(near.join(params.drop("by_lang", "was"), "key")).selectExpr("*", f"floor(ln(d2 + 0.000001D) * {BINS}) AS bin")
    binned = aggregated(away, ["by_lang", "key", "start", "bin"], [*ADDED_UP, "max(log_det) AS was"])
    group = "(PARTITION BY key, start"
    before = f"coalesce(sum(n) OVER {group} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D)"  # bins are few
    kept = binned.selectExpr("*", f"{before} AS before", f"sum(n) OVER {group}) AS whole").where(f"before < ceil(whole * {NEAREST}D)")
    return aggregated(kept, ["by_lang", "key", "start"], [*[f"sum({c}) AS {c}" for c in SUMS], "max(was) AS was"])


def estimate(near: DataFrame, folder: str) -> DataFrame | None:
    """Per key the robust centre and scatter, of near (by_lang, key, x0..); None if there are no rows."""
    starts = F.array(F.lit(0), F.when((F.col("x2") < 1) & (F.col("x3") < 1) & (F.col("x4") < 1), 1))  # all rows, and those of ordinary counts
    first = near.select("*", F.explode(starts).alias("start")).where("start is not null")
    first = written(aggregated(first, ["by_lang", "key", "start"], ADDED_UP), folder, "starts")
    told = lambda df: F.broadcast(df) if groups <= BROADCAST_GROUPS else df
    params = written(scatter(first), folder, "step_0")
    groups = params.count()
    if not groups:
        return None
    for k in range(1, STEPS_FIRST + STEPS_LAST + 1):
        nearest = written(nearest_sums(near, told(params)), folder, f"nearest_{k}")  # small, and read twice
        params = written(scatter(nearest), folder, f"step_{k}")
        if k == STEPS_FIRST:
            params = params.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("log_det", "start"))).where("rank = 1").drop("rank")  # two rows a key
        elif k > STEPS_FIRST and params.agg(F.expr("max(abs(log_det - was))")).first()[0] < SETTLED:
            break  # every group has settled
    return told(params.drop("start", "log_det", "by_lang", "was"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    distance is the squared Mahalanobis distance, null where the plain rules fail or nothing is estimated.
    """
    folder = shared_folder(docs.sparkSession)
    stats = written(keyed(statistics(docs, id_col, text_col, lang_col, source_col)), folder, "statistics")
    rows = written(vectors(stats, folder), folder, "vectors")
    params = estimate(rows.where("not base_failed").select("by_lang", "key", *X), folder)
    judged = rows.withColumn("d2", F.lit(None).cast("double")) if params is None else distance(rows.join(params, "key", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"))
