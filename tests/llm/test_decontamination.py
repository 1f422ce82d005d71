import hashlib
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm.decontamination import contamination, decontaminate, hits, item_windows, with_windows
from helixframe.llm.common import shared_folder, written

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item here"), (3, "one"), (4, None), (5, "..."), (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        x = words(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit.update(range(at, at + n))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


TEXTS = ["x ALPHA, beta-gamma; delta (epsilon) zeta\neta theta iota kappa end", "a short ITEM here and one more one", "alpha beta gamma delta epsilon zeta eta theta iota", "Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "café über alpha", None, "", "...", "one"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("bound", [1_000_000, 0])  # broadcast, and the shuffled way beyond the bound
def test_matches_brute_force(make, items, bound):
    rows = {r.doc_id: r for r in contamination(make(TEXTS), items, broadcast_windows=bound).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, ITEMS), t


def test_window_hashes_do_not_depend_on_what_is_around(spark):
    df = spark.createDataFrame([(list("abcdefghijklm"),), (list("xcdefghijkl"),), ([],)], "words array<string>")
    for k in range(1, 11):
        one, two, none = (r[0] for r in with_windows(df, "words", [k], "h").select(f"h_{k}").collect())
        assert (len(one), len(two), len(none)) == (14 - k, 12 - k, 0) and one[2:11 - k + 1] == two[1:11 - k]


def test_removing_documents_and_spans(make, items):
    docs = make(TEXTS)
    kept = decontaminate(docs, items)
    assert sorted(r.doc_id for r in decontaminate(docs, items, broadcast_windows=0, broadcast_rows=0).collect()) == sorted(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[4]]
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, remove="spans").collect()}
    assert cut[0] == "x end" and cut[1] == "a and more " and cut[2] == TEXTS[2] and cut[5] is None
    assert not any(brute(t, ITEMS)[4] for t in cut.values())


def test_words_are_cut_once_in_the_plan(spark, make):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(i))) for i in range(1, 14)], "item_id long, text string")
    folder = shared_folder(spark)
    windows = written(item_windows(items), folder, "windows")
    for bound in (1_000_000, 0):
        plan = hits(make(TEXTS), windows, [F.col("doc_id")], folder, broadcast_windows=bound)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 2


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_items_of_many_lengths(spark, make, bound):
    items = [(i, " ".join(f"w{(i * k) % 5}" for k in range(i))) for i in range(1, 14)]
    texts = [" ".join(f"w{(a * k) % 5}" for k in range(40)) for a in range(1, 9)] + ["w0 x w0", "w1"]
    rows = {r.doc_id: r for r in contamination(make(texts), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=bound).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(t, items), t


def test_odd_rows(odd, empty, items):
    assert contamination(odd, items).count() == odd.count()
    assert decontaminate(odd, items).columns == odd.columns and decontaminate(odd, items, remove="spans").columns == odd.columns
    assert contamination(empty, items).count() == 0 and decontaminate(empty, items).count() == 0
    assert contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate(odd, items.limit(0)).count() == odd.count()
