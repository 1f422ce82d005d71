import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.common import shared_folder
from helixframe.llm.robust_outliers import ADDED_UP, CONSISTENT, CUTOFF, NEAREST, X, aggregated, distance, estimate, nearest_sums, quality_rules, scatter


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_statistics_match_brute_force(make, text_of):
    r = random.Random(5)
    texts = [text_of(i, r.randint(1, 120)) for i in range(40)] + ["a b c d e " * 6, "a a a a a a a", "x\nx\n \nx y\n", None, "", "1 2 3 4 5 6 7 8 9", " ".join("abcdefghij") + " " + " ".join("abcdefghij"), "p q r s t u p q r s t u v w p q r s t"]
    rows = {x.doc_id: x for x in quality_rules(make(texts)).collect()}
    for i, t in enumerate(texts):
        w = brute(t)
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == w, t
        assert x.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
        assert x.base_failed or x.distance is not None
        assert x.kept == (not x.base_failed and x.distance <= CUTOFF)


def test_outliers_go_and_others_stay(make, text_of):
    r = random.Random(7)
    good = [text_of(i, r.randint(60, 400)) for i in range(600)]
    bad = [" ".join(w + "###$$" for w in text_of(i, 100).split()) for i in range(30)]
    rows = {x.doc_id: x for x in quality_rules(make(good + bad)).collect()}
    assert all(rows[i].kept for i in range(600) if not rows[i].base_failed)
    assert not any(rows[i].kept for i in range(600, 630))


def test_verdicts_do_not_depend_on_partitions(make, text_of):
    r = random.Random(9)
    df = make([text_of(i, r.randint(10, 300)) + "#" * r.randint(0, 30) for i in range(400)])
    said = lambda d: {x.doc_id: (x.kept, x.distance) for x in quality_rules(d).where("distance is not null").collect()}
    one, two = said(df.repartition(2)), said(df.repartition(7, "doc_id"))
    assert one.keys() == two.keys()
    assert all(one[i][0] == two[i][0] and one[i][1] == pytest.approx(two[i][1], rel=1e-6) for i in one)


def plain_mcd(x, share=NEAREST):
    """The textbook estimate of one group: many random starts, concentration steps to the end."""
    best = None
    r = np.random.default_rng(0)
    h = int(np.ceil(len(x) * share))
    for _ in range(20):
        inner = x[r.choice(len(x), 12, replace=False)]
        for _ in range(50):
            m, c = inner.mean(0), np.cov(inner.T, bias=True) + 1e-9 * np.eye(x.shape[1])
            d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
            inner = x[np.argsort(d)[:h]]
        det = np.linalg.slogdet(np.cov(inner.T))[1]
        if best is None or det < best[0]:
            best = det, inner.mean(0), np.cov(inner.T, bias=True) * CONSISTENT
    return best[1:]


def test_estimates_are_those_of_a_plain_mcd(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(5, 5))
    groups = {"big": 3000, "middle": 400, "small": 12}
    parts = {}
    for k, n in groups.items():
        x = r.normal(size=(n, 5)) @ a + 3
        out = r.random(n) < 0.15
        x[out] += 30
        parts[k] = x, out
    rows = [("=en", f"=en\x01={k}", *map(float, v)) for k, (x, _) in parts.items() for v in x]
    df = spark.createDataFrame(rows, "by_lang string, key string, " + ", ".join(f"{c} double" for c in X))
    found = distance(df.join(estimate(df, shared_folder(spark)), "key")).select("key", *X, "d2").collect()
    got = {(x.key.rpartition("=")[2], round(x.x0, 9), round(x.x1, 9)): x.d2 for x in found}
    for k, (x, out) in parts.items():
        d = np.array([got[k, round(float(v[0]), 9), round(float(v[1]), 9)] for v in x])
        assert (d[out] > CUTOFF).all() and (d[~out] < CUTOFF).mean() > 0.99, k
        if k != "small":
            assert 3.6 < np.median(d[~out]) < 5.2, k  # 4.351 is the median of chi-square with five degrees
    x, out = parts["big"]
    m, c = plain_mcd(x)
    want = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    d = np.array([got["big", round(float(v[0]), 9), round(float(v[1]), 9)] for v in x])
    assert np.abs(d[~out] / want[~out] - 1).mean() < 0.1


def test_groups_of_any_size_are_judged_by_one_rule(make, text_of):
    r = random.Random(13)
    texts = [text_of(i, r.randint(60, 400)) for i in range(300)]
    bad = " ".join(w + "#&%|" for w in text_of(77, 120).split())
    docs = make(texts, source="large").union(make([(1000 + i, text_of(500 + i, 150)) for i in range(3)] + [(1003, bad)], source="tiny"))
    rows = {x.doc_id: x for x in quality_rules(docs).collect()}
    assert not rows[1003].kept and all(rows[1000 + i].kept for i in range(3))


def test_few_rows_are_judged_too(make, text_of):
    texts = [text_of(i, 150) for i in range(12)] + [" ".join(w + "#&%|" * 3 for w in text_of(77, 120).split())]
    rows = {x.doc_id: x for x in quality_rules(make(texts)).collect()}
    assert not rows[12].kept and all(rows[i].kept for i in range(12))
    (lone,) = quality_rules(make(texts[:1])).collect()
    assert lone.kept and lone.distance < 1


def test_a_very_long_text(make, text_of):
    long = " ".join(text_of(i, 5000) for i in range(20))
    row = {x.doc_id: x for x in quality_rules(make([text_of(i, 200) for i in range(40)] + [long])).collect()}[40]
    assert row.n_words == 100_000 and row.n_repeat_words == brute(long)[4]


def test_odd_rows(odd, empty):
    assert quality_rules(odd).count() == odd.count()
    assert quality_rules(empty).count() == 0


def test_a_step_is_few_commands_to_the_driver(spark, monkeypatch):
    """Columns made one by one were some 10,000 objects of the driver's JVM for each step."""
    client = spark.sparkContext._gateway._gateway_client
    sent, send = [0], client.send_command

    def counted(*args, **more):
        sent[0] += 1
        return send(*args, **more)

    columns = [F.randn(i).alias(x) for i, x in enumerate(X)]
    near = spark.range(100).select(F.lit("=en").alias("by_lang"), F.lit("=en-a").alias("key"), F.lit(0).alias("start"), *columns)
    monkeypatch.setattr(client, "send_command", counted)
    params = scatter(aggregated(near, ["by_lang", "key", "start"], ADDED_UP))
    scatter(nearest_sums(near.drop("start"), params))
    assert 0 < sent[0] < 3000
