import warnings

import numpy as np
import pytest

from helixframe.llm.source_mixing import DOMAINS, TARGETS, fit_domains, fit_rates, mix, mixing_rates, sampled_labels


@pytest.fixture(scope="module")
def tables(spark, make, text_of):
    texts = [text_of(i, 40 + i % 60) + (" vile scum" if i % 10 == 0 else " junk ###" if i % 5 == 1 else " fine") for i in range(300)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 1 else 1, 1 if i % 10 == 0 else 0) for i in range(0, 300, 2)] + [(i, 0 if i % 5 == 1 else 1, 0) for i in range(1, 200, 2)] + [(None, 1, 0), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return make(texts), labels


def test_targets_are_met(tables):
    docs, labels = tables
    targets = {"poor": 0.3, "good": 0.6, "toxic": 0.1}
    rows = mixing_rates(docs, labels, targets).toPandas()
    total = rows.n_tokens.sum()
    for d in DOMAINS:
        assert abs((rows.rate * rows.n_tokens * rows[f"p_{d}"]).sum() / total - targets[d]) < 0.01
    assert (rows.rate >= 0).all() and np.isclose(rows[[f"p_{d}" for d in DOMAINS]].sum(axis=1), 1).all()
    assert ((rows.copies - rows.rate).abs() < 1).all()
    toxic = rows[(rows.doc_id % 10 == 0)]
    assert (toxic.p_toxic > toxic.p_good).mean() > 0.9


def projected_gradient(t, p, goal, steps=20_000):
    """The plain method, accelerated: the distance from the goal that it comes to."""
    w = t / t.sum()
    length = 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
    rate = before = np.ones(len(t))
    momentum = 1.0
    for _ in range(steps):
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = rate + (momentum - 1) / after * (rate - before)
        error = (w * ahead) @ p - goal
        before, momentum = rate, after
        rate = np.maximum(0, ahead - length * (p @ error))
        if (rate - before) @ (p @ error) > 0:
            momentum = 1.0
    return np.linalg.norm((w * rate) @ p - goal)


def dirichlet(spark, alpha, n, seed=3):
    rng = np.random.default_rng(seed)
    p, t = rng.dirichlet(alpha, n), rng.integers(1, 100, n)
    return t, p, spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "t long, p array<double>")


@pytest.mark.parametrize("goal", [(0.7, 0.2, 0.1), (0.01, 0.98, 0.01), (0.12, 0.85, 0.03)])
@pytest.mark.parametrize("alpha", [(1, 2, 1), (0.1, 0.2, 0.1), (30, 40, 20)])  # mixed, separable, soft: the last one reaches none of the goals
def test_rates_are_a_least_squares_optimum(spark, alpha, goal):
    t, p, df = dirichlet(spark, alpha, 60)
    fit = fit_rates(df, "t", "p", dict(zip(DOMAINS, goal)))
    r = np.array([x[0] for x in df.select(fit.rate("p")).collect()])
    got = (r * t) @ p / t.sum()
    assert fit.optimal and (r >= 0).all()
    assert np.allclose(got, [fit.shares[d] for d in DOMAINS], atol=1e-9)
    assert abs(np.linalg.norm(got - goal) - projected_gradient(t, p, np.array(goal))) < 1e-3


@pytest.mark.parametrize("goal", [(0.12, 0.85, 0.03), (0.0, 1.0, 0.0), (0.5, 0.0, 0.5)])
@pytest.mark.parametrize("rows", [1, 500])
def test_one_domain_is_proved_optimal(spark, rows, goal):
    df = spark.range(rows).selectExpr("id % 9 + 1 AS t", "array(0D, 1D, 0D) AS p")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fit = fit_rates(df, "t", "p", dict(zip(DOMAINS, goal)))
    assert fit.optimal and fit.passes < 40
    assert fit.error == pytest.approx(np.hypot(goal[0], goal[2]), abs=1e-3)


def test_an_unfinished_fit_is_flagged(spark):
    _, _, df = dirichlet(spark, (30, 40, 20), 60)
    with pytest.warns(UserWarning, match="not proved optimal"):
        fit = fit_rates(df, "t", "p", TARGETS, passes=2)
    assert not fit.optimal


def test_labels_are_thinned_by_id(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "CAST(id % 100 = 0 AS int) AS toxic")
    some = sampled_labels(labels, 2000).groupBy("label").agg({"*": "count", "weight": "sum"}).collect()
    n = {r.label: r["count(1)"] for r in some}
    assert n[2.0] == 300 and all(800 < n[x] < 1200 for x in (0.0, 1.0))  # a class of under 1000 stays whole
    assert all(abs(r["sum(weight)"] / 2000 - {2.0: 0.01, 1.0: 0.5, 0.0: 0.49}[r.label]) < 0.05 for r in some)


def test_mixture_repeats_rows(tables):
    docs, labels = tables
    copies = {r.doc_id: r.copies for r in mixing_rates(docs, labels).collect()}
    out = mix(docs, labels)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n}


def test_odd_rows(spark, odd, empty, tables):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 0), (5, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing_rates(odd, labels).count() == odd.count()
    assert mix(odd, labels).columns == odd.columns
    none = labels.limit(0)
    assert fit_domains(odd, none) is None and mixing_rates(odd, none).count() == odd.count()
    assert mixing_rates(empty, labels).count() == 0 and mix(empty, labels).count() == 0
