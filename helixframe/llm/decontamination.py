"""Operator 10, benchmark decontamination with DataFrame functions only.

Test items and documents are normalised alike: A-Z in lower case, words of letters, digits and
non-ASCII characters. Ten consecutive words of an item, or a shorter item as a whole, are a window.
The windows form a set keyed by hashes of 64 bits. A document's windows are hashed by doubling, two
words, four, eight and ten, and looked up in the set, which is broadcast when its counted rows are
within a bound. Only where a hash is met are the window's words put together and compared, so each
hit is verified, and runs of hits become spans. Beyond the bound a bit set sized by their count,
broadcast instead, leaves few candidates, and the words of these windows alone are shuffled. Windows
that an item or several items share are one window; ties do not arise.

Defined results: null or empty texts have no words and no hits; null texts of items have no
windows, null item_ids are not listed; repeated item rows count once, items of equal text each; each
input row gives one row (repeated rows repeat, a null doc_id stays null). Very long texts are scanned
whole like any other. Extra columns are ignored by the report; the filter and the span removal keep
all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, fresh, shared_folder, written

#: Characters between words: ASCII without letters and digits (after lower-casing).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*"
NGRAM = 10
#: Windows of a benchmark up to which their set is broadcast (one text of about 100 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Words of 64 bits of the bit set beyond that, at least and at most (16 MB).
BIT_WORDS, MOST_BIT_WORDS = 1 << 14, 1 << 21


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower_fast(text), BETWEEN), lambda w: w != "")


def ascii_lower_fast(text: Column) -> Column:
    """lower() where the text is ASCII only (the bytes are as many as the characters), else translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def after(hashes: Column, k: int) -> Column:
    """The array from its k-th element on."""
    return F.slice(hashes, F.lit(k + 1), F.greatest(F.size(hashes) - k, F.lit(0)))


def paired(one: Column, two: Column) -> Column:
    """The hash of both elements where both arrays have one."""
    n = F.least(F.size(one), F.size(two))
    return F.zip_with(F.slice(one, F.lit(1), n), F.slice(two, F.lit(1), n), lambda x, y: F.xxhash64(x, y))


def with_windows(df: DataFrame, words: str, lengths: list[int], name: str) -> DataFrame:
    """df with name_L for each length L: the hashes of all windows of L words, by their places.

    Powers of two come from two halves, other lengths from the largest power and the rest.
    """
    columns = list(df.columns)
    df = df.withColumn(f"{name}_1", F.transform(words, lambda w: F.xxhash64(w)))
    have = {1}

    def need(length: int) -> None:
        nonlocal df
        if length in have:
            return
        half = 1 << (length.bit_length() - 1)
        half = half // 2 if half == length else half
        need(half)
        need(length - half)
        df = df.withColumn(f"{name}_{length}", paired(F.col(f"{name}_{half}"), after(F.col(f"{name}_{length - half}"), half)))
        have.add(length)

    for length in sorted(lengths):
        need(length)
    return df.select(*columns, *[f"{name}_{length}" for length in lengths])


def item_windows(items: DataFrame, n: int = NGRAM) -> DataFrame:
    """(item, window, len): the windows of each item, an item of under n words as a whole."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    split = split.withColumn("len", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    return split.select("item", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("len")), " "))).alias("window")).distinct()


def window_set(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, window_len, window_hash): distinct windows with the hash that documents' windows of that length have."""
    distinct = windows.select("window", F.col("len").alias("window_len")).distinct().withColumn("words", F.split("window", " "))
    hashed = with_windows(distinct, "words", lengths, "h")
    own = [F.when(F.col("window_len") == k, F.get(f"h_{k}", F.lit(0))) for k in lengths]
    return hashed.select("window", "window_len", (F.coalesce(*own) if own else F.lit(None)).cast("long").alias("window_hash"))


def bit_of(h: Column, size: int) -> tuple[Column, Column]:
    """The word and the bit of a hash in a bit set of so many words."""
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(size)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def maybe_in(windows: DataFrame, count: int, h: Column) -> Column:
    """Whether the bit of the hash is set: false only for hashes that no window has. Sixteen bits a window, within bounds."""
    size = min(MOST_BIT_WORDS, max(BIT_WORDS, 1 << (count // 4).bit_length()))
    word, bit = bit_of(F.col("window_hash"), size)
    words = windows.select(word.alias("word"), bit.alias("bit")).distinct().groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = windows.sparkSession.range(size).select(F.col("id").cast("int").alias("word")).join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    held = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("held"))  # one row of bounded size
    word, bit = bit_of(h, size)
    return F.getbit(F.get(held.scalar(), word), bit) == 1


def hits(docs: DataFrame, windows: DataFrame, keys: list[Column], folder: str, text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, all_rows: bool = True) -> DataFrame:
    """The keys, n_words, and per occurring window (pos, len, window); with all_rows, a row of nulls for each document besides.

    Each word's place gives a hash for each length that items have; words stay where they are, and
    a window's text exists only where its hash is met. windows: item_windows, as a table. The set of
    their hashes is a table as well: conditions on it are then not worked out from the words again.
    """
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count_distinct("window").alias("n")).collect()}  # a row for each length
    lengths = sorted(sizes)
    found = written(window_set(windows, lengths), folder, "window_set")
    base = docs.select(*keys, words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).withColumn("n_words", F.size("words"))
    names = [c for c in base.columns if c != "words"]
    base = with_windows(base, "words", lengths, "h")
    parts = [F.col(f"h_{k}") for k in lengths]
    if all_rows or not parts:
        parts.append(F.array(F.lit(None).cast("long")))
    each = base.select(*names, "words", F.posexplode(F.concat(*parts)).alias("at", "hash"))
    if sum(sizes.values()) <= broadcast_windows:
        pos, _ = place_of(lengths, F.col("window_len"))
        same = F.array_join(F.slice("words", pos + 1, F.col("window_len")), " ") == F.col("window")
        met = each.join(F.broadcast(found), (F.col("hash") == F.col("window_hash")) & same, "left" if all_rows else "inner")
        return met.where("hash is null or window is not null").select(*names, pos.alias("pos"), F.col("window_len").alias("len"), "window")
    # a candidate takes the words of its window along, not those of its text; rows of nulls get keys of their own, so that they spread over all tasks
    pos, size = place_of(lengths, None)
    some = each.where(F.col("hash").isNull() | maybe_in(found, sum(sizes.values()), F.col("hash")))
    text = F.when(F.col("hash").isNotNull(), F.array_join(F.slice("words", pos + 1, size), " "))
    some = some.select(*names, pos.alias("pos"), size.alias("len"), text.alias("seen"), F.coalesce("hash", F.xxhash64(*names)).alias("key"))
    met = some.join(found, (F.col("key") == F.col("window_hash")) & (F.col("seen") == F.col("window")) & (F.col("len") == F.col("window_len")), "left")
    met = met.where("seen is null or window is not null")
    return met.select(*names, "pos", F.col("window_len").alias("len"), "window")


def place_of(lengths: list[int], length: Column | None) -> tuple[Column, Column]:
    """Where the window begins whose hash is at place `at` of all hashes of a document, and its length (if that is not known, by the place)."""
    if length is None:
        length, end = F.lit(None).cast("int"), F.lit(0)
        ends = []
        for k in lengths:
            end = end + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
            ends.append((end, k))
        for end, k in reversed(ends):
            length = F.when(F.col("at") < end, k).otherwise(length)
    before = F.lit(0)
    for k in lengths:
        before = before + F.when(length > k, F.greatest(F.col("n_words") - (k - 1), F.lit(0))).otherwise(F.lit(0))
    return F.greatest(F.col("at") - before, F.lit(0)), length


def covered(spans: Column) -> Column:
    """How many places sorted array<struct<pos, len>> covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(held: Column, x: Column) -> Column:
        end = F.greatest(held["end"], x["pos"] + x["len"])
        return F.struct(end.alias("end"), (held["total"] + end - F.greatest(held["end"], x["pos"])).alias("total"))

    return F.aggregate(spans, start, add, lambda held: held["total"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    The rows are told apart by their place in the scan; one explode, one lookup and one aggregation
    that is combined before its shuffle. Items are joined to a document's distinct windows afterwards.
    """
    folder = shared_folder(docs.sparkSession)
    windows = written(item_windows(items, n), folder, "windows")
    keys = [F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row")]
    found = hits(docs, windows, keys, folder, text_col, broadcast_windows)
    span = F.when(F.col("window").isNotNull(), F.struct("pos", "len"))
    per = found.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("window").alias("windows"))
    per = written(per.select("row", "doc_id", "n_words", F.size("spans").alias("n_spans"), covered(F.col("spans")).alias("n_hit"), "windows"), folder, "found")
    held = windows.where("item is not null").select("window", "item")
    held = F.broadcast(held) if held.count() <= broadcast_windows else held
    each = per.where("n_spans > 0").select("row", F.explode("windows").alias("window")).join(held, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    met = per.join(each, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    listed = F.sha2(F.array_join("items", ","), 256)
    return met.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_words", "n_hit")], F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = NGRAM, remove: str = "documents", broadcast_rows: int = 200_000, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit words in them.

    Contamination depends on the text alone, so verdicts are joined by the text's digest: rows of
    equal texts share their fate, and nulls in other columns do not matter.
    """
    folder = shared_folder(docs.sparkSession)
    digest = F.md5(F.col(text_col))
    found = hits(docs, written(item_windows(items, n), folder, "windows"), [digest.alias("digest")], folder, text_col, broadcast_windows, all_rows=False)
    key = fresh(docs, "digest")
    if remove == "documents":
        bad = written(found.select(F.col("digest").alias(key)).distinct(), folder, "contaminated")  # found once
        bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
        return docs.withColumn(key, digest).join(bad, key, "left_anti").drop(key)
    spans = fresh(docs, "spans")
    cut = written(found.select(F.col("digest").alias(key), F.struct("pos", "len").alias("at")).distinct().groupBy(key).agg(F.collect_list("at").alias(spans)), folder, "cuts")
    cut = F.broadcast(cut) if cut.count() <= broadcast_rows // 10 else cut
    met = docs.withColumn(key, digest).join(cut, key, "left")
    lead = F.regexp_extract(F.col(text_col), "^" + BETWEEN.removesuffix("+").replace("\\x60", "\\x40\\x5B-\\x60") + "*", 0)
    piece = PIECE.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({piece})"), 1)
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col(spans), lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"])))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(left, "")))
    return met.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


CONTAMINATION_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT DISTINCT item_id, words, least(len(words), 10) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL)
  WHERE len(words) > 0
), bi AS (
  SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM b
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS w FROM bi
), di AS (
  SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n
), dw AS (
  SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS w FROM di
), h AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(places.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(places.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN its USING (r)
"""
