"""Batch association tests and stacked ridge models against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe import functions as fx
from helixframe.functions.regression import linear_regression_gwas, logistic_regression_gwas
from helixframe.gwas import linear_regression, logistic_regression
from helixframe.gwas.logistic import fit_null
from helixframe.stats.regression import firth, firth_slopes, log_likelihood, sigmoid
from helixframe.stats.special import chi2_tail, t_two_sided
from helixframe.wgr.base import Stage, best_alphas, new_headers
from helixframe.wgr import LogisticRidgeRegression, RidgeReduction, RidgeRegression, block_variants_and_samples, estimate_loco_offsets, get_sample_ids, reshape_for_gwas

N, M = 60, 12


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    x = r.integers(0, 3, (M, N)).astype(float)
    ids = [f"s{i}" for i in range(N)]
    c = pd.DataFrame(r.normal(size=(N, 2)), index=ids, columns=["age", "sex"])
    y = pd.DataFrame({"a": x[0] + r.normal(size=N), "b": 0.5 * x[1] - c["age"].to_numpy() + r.normal(size=N)}, index=ids)
    p = pd.DataFrame({"p": (r.random(N) < 1 / (1 + np.exp(-(x[2] - 1)))).astype(float), "q": (r.random(N) < 0.4).astype(float)}, index=ids)
    df = spark.createDataFrame([(str(1 + i % 2), i, v.tolist()) for i, v in enumerate(x)], "contigName string, idx int, values array<double>")
    return x, ids, c, y, p, df


def ols(x, y, c):
    d = np.column_stack([np.ones(len(y)), c, x])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    e = y - d @ b
    dof = len(y) - d.shape[1]
    se = np.sqrt(e @ e / dof * np.linalg.inv(d.T @ d)[-1, -1])
    return b[-1], se, b[-1] / se, float(t_two_sided(b[-1] / se, dof))


def test_linear_equals_least_squares(data):
    x, ids, c, y, _, df = data
    rows = linear_regression(df, y, c).toPandas()
    assert list(rows.columns) == ["contigName", "idx", "effect", "stderror", "tvalue", "pvalue", "phenotype"] and len(rows) == 2 * M
    for r in rows.itertuples():
        want = ols(x[r.idx], y[r.phenotype].to_numpy(), c.to_numpy())
        assert (r.effect, r.stderror, r.tvalue, r.pvalue) == pytest.approx(want, rel=1e-8)
    long = linear_regression(df, y, c, verbose_output=True).toPandas()
    assert (long.n == N).all() and np.allclose(long[long.phenotype == "a"].sum_x, [x[i].sum() for i in long[long.phenotype == "a"].idx])


def test_linear_missing_offsets_and_subsets(data):
    x, ids, c, y, _, df = data
    gone = y.copy()
    gone.iloc[3, 0] = np.nan
    rows = linear_regression(df, gone, c, verbose_output=True).toPandas()
    assert set(rows[rows.phenotype == "a"].n) == {N - 1} and rows.pvalue.between(0, 1).all()
    zero = pd.DataFrame(0.0, index=ids, columns=y.columns)
    same = lambda a, b: np.allclose(a.toPandas().sort_values(["phenotype", "idx"]).effect, b.toPandas().sort_values(["phenotype", "idx"]).effect)
    assert same(linear_regression(df, y, c, zero), linear_regression(df, y, c))
    loco = pd.concat([zero.assign(contigName=k).set_index("contigName", append=True) for k in ("1", "2")])
    assert same(linear_regression(df, y, c, loco), linear_regression(df, y, c))
    part = linear_regression(df, y.iloc[:50], c, intersect_samples=True, genotype_sample_ids=ids).toPandas()
    r = part[(part.idx == 4) & (part.phenotype == "b")].iloc[0]
    assert r.effect == pytest.approx(ols(x[4][:50], y["b"].to_numpy()[:50], c.to_numpy()[:50])[0])
    single = linear_regression(df, y, c, dt=np.float32)
    assert dict(single.dtypes)["effect"] == "float"


def test_inputs_are_checked(data):
    _, ids, c, y, p, df = data
    with pytest.raises(ValueError, match="same number of rows"):
        linear_regression(df, y, c.iloc[:5])
    with pytest.raises(ValueError, match="covariate"):
        linear_regression(df, y, c.assign(age=np.nan))
    with pytest.raises(ValueError, match="same column names"):
        linear_regression(df, y, c, pd.DataFrame(0.0, index=ids, columns=["z"]))
    with pytest.raises(ValueError, match="contig 2 need one row for each sample"):
        short = pd.concat([pd.DataFrame(0.0, index=i, columns=y.columns).assign(contigName=k).set_index("contigName", append=True) for k, i in (("1", ids), ("2", ids[1:]))])
        linear_regression(df, y, c, short)
    with pytest.raises(ValueError, match="dt must be"):
        linear_regression(df, y, c, dt=np.int32)
    with pytest.raises(ValueError, match="correction"):
        logistic_regression(df, p, c, correction="firth")
    with pytest.raises(ValueError, match="genotype_sample_ids"):
        linear_regression(df, y, c, intersect_samples=True)


def test_logistic_score_test(data):
    x, ids, c, _, p, df = data
    rows = logistic_regression(df, p, c, correction="none").toPandas()
    d = np.column_stack([np.ones(N), c.to_numpy()])
    for r in rows.itertuples():
        y = p[r.phenotype].to_numpy()
        mu = fit_null(y, d, np.zeros(N))
        g = mu * (1 - mu)
        res = x[r.idx] - d @ np.linalg.solve(d.T @ (g[:, None] * d), d.T @ (g * x[r.idx]))
        chisq = (res @ (y - mu)) ** 2 / (g * res * res).sum()
        assert r.chisq == pytest.approx(chisq, rel=1e-6) and r.pvalue == pytest.approx(float(chi2_tail(chisq)), rel=1e-6)


def test_logistic_firth_and_loco(data):
    _, ids, c, _, p, df = data
    rows = logistic_regression(df, p, c, pvalue_threshold=0.3).toPandas()
    tried = rows[rows.correctionSucceeded.notna()]
    assert len(tried) and tried.correctionSucceeded.all() and (np.abs(tried.effect) < 5).all() and (tried.stderror > 0).all()
    rest = rows[rows.correctionSucceeded.isna()]
    assert rest.effect.isna().all()
    zero = pd.concat([pd.DataFrame(0.0, index=ids, columns=p.columns).assign(contigName=k).set_index("contigName", append=True) for k in ("1", "2")])
    order = lambda d: d.toPandas().sort_values(["phenotype", "idx"]).pvalue.to_numpy()
    assert np.allclose(order(logistic_regression(df, p, c, zero)), order(logistic_regression(df, p, c)))


def test_firth_fits_of_a_batch():
    r = np.random.default_rng(2)
    x = r.integers(0, 3, (N, 9)).astype(float) - 1
    x[:, 8] = 0.0
    y, offset = (r.random(N) < 0.3).astype(float), r.normal(size=N) / 4
    y[x[:, 7] > 0] = 1.0  # separates
    slope, information, gain, settled = firth_slopes(x, y, offset)
    assert settled[:8].all() and not settled[8]
    for j in range(8):
        b, mu, value = firth(x[:, j : j + 1], y, offset, np.zeros(1))
        zero = sigmoid(offset)
        null = log_likelihood(y, zero) + 0.5 * np.log((zero * (1 - zero) * x[:, j] ** 2).sum())
        assert slope[j] == pytest.approx(b[0], abs=1e-5) and gain[j] == pytest.approx(2 * (value - null), abs=1e-6)
        grid = np.linspace(slope[j] - 0.5, slope[j] + 0.5, 1001)
        means = sigmoid(offset[:, None] + x[:, j : j + 1] * grid)
        height = (np.log(np.where(y[:, None] > 0, means, 1 - means))).sum(0) + 0.5 * np.log((means * (1 - means) * x[:, j : j + 1] ** 2).sum(0))
        assert abs(grid[height.argmax()] - slope[j]) < 2e-3
        assert information[j] == pytest.approx((mu * (1 - mu) * x[:, j] ** 2).sum(), rel=1e-4)


@pytest.fixture(scope="module")
def stacked(spark):
    r = np.random.default_rng(5)
    n, ids = 40, [f"s{i}" for i in range(40)]
    x = r.integers(0, 3, (18, n)).astype(float)
    g = spark.createDataFrame([(str(1 + i // 6), i, i + 1, "A", ["C"], v.tolist(), [(s, [0, 1]) for s in ids]) for i, v in enumerate(x)], "contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, values array<double>, genotypes array<struct<sampleId:string,calls:array<int>>>")
    y = pd.DataFrame({"t": x[0] + x[7] + r.normal(size=n), "u": x[13] + r.normal(size=n)}, index=ids)
    assert get_sample_ids(g) == ids
    blocks, samples = block_variants_and_samples(g, ids, 3, 4)
    return x, ids, y, blocks, samples


def test_ridge_reduction_equals_numpy(stacked):
    x, ids, y, blocks, samples = stacked
    alphas = [1.0, 50.0]
    rows = RidgeReduction(blocks, y, samples, alphas=alphas).fit_transform().toPandas()
    assert len(rows) == 6 * 4 * 2 * 2 and set(rows.header_block) == {"chr_1", "chr_2", "chr_3"}
    raw = x[3:6].T
    sx = np.column_stack([np.ones(40), (raw - raw.mean(0)) / raw.std(0, ddof=1)])
    sy = ((y - y.mean()) / y.std()).to_numpy()
    fold = [i for i, s in enumerate(ids) if s in samples["2"]]
    rest = [i for i in range(40) if i not in fold]
    b = np.linalg.solve(sx[rest].T @ sx[rest] + np.diag([1, 50, 50, 50]), sx[rest].T @ sy[rest])
    got = rows[(rows["sample_block"] == "2") & (rows.header == "chr_1_block_1_alpha_1_label_u")].iloc[0]
    assert np.allclose(got["values"], sx[fold] @ b[:, 1]) and got.mu == pytest.approx((sx[fold] @ b[:, 1]).mean())


def test_ridge_regression_and_loco(stacked):
    x, ids, y, blocks, samples = stacked
    reduction = RidgeReduction(blocks, y, samples, alphas=[1.0, 20.0])
    reduction.fit_transform()
    model = RidgeRegression.from_ridge_reduction(reduction, [0.1, 10.0, 1000.0])
    whole = model.fit_transform()
    assert list(whole.index) == ids and list(whole.columns) == ["t", "u"]
    assert np.corrcoef(whole["t"], y["t"])[0, 1] > 0.3
    best = {r.label: r.alpha for r in model.cv_df.collect()}
    assert set(best) == {"t", "u"} and set(best.values()) <= {"alpha_0", "alpha_1", "alpha_2"}
    loco = model.transform_loco()
    assert loco.index.get_level_values(1).unique().tolist() == ["1", "2", "3"] and len(loco) == 120
    # without the chromosome that holds its signal a label is predicted worse
    corr = lambda c: np.corrcoef(loco.xs(c, level=1)["u"], y["u"])[0, 1]
    assert corr("3") < corr("1")
    again = estimate_loco_offsets(blocks, y, samples, reduction_alphas=[1.0, 20.0], regression_alphas=[0.1, 10.0, 1000.0])
    assert np.allclose(again, loco)


def test_logistic_ridge(stacked):
    x, ids, y, blocks, samples = stacked
    binary = (y > y.median()).astype(float)
    reduction = RidgeReduction(blocks, binary, samples, alphas=[1.0, 20.0])
    reduction.fit_transform()
    model = LogisticRidgeRegression.from_ridge_reduction(reduction, [1.0, 100.0])
    linear = model.fit_transform()
    p = model.transform("sigmoid")
    assert ((p > 0) & (p < 1)).all(axis=None) and np.corrcoef(linear["t"], binary["t"])[0, 1] > 0.2
    loco = estimate_loco_offsets(blocks, binary, samples, reduction_alphas=[1.0, 20.0], regression_alphas=[1.0, 100.0], chromosomes=["2"])
    assert len(loco) == 40 and loco.notna().all(axis=None)
    with pytest.raises(ValueError):
        model.transform("cubic")
    with pytest.raises(TypeError):
        RidgeReduction(blocks, y, samples, label_type="binary")


def test_reshape(spark):
    one = pd.DataFrame({"label1": [1, 2], "label2": [3, 4]}, index=["a", "b"])
    assert [tuple(r) for r in reshape_for_gwas(spark, one).collect()] == [("label1", [1, 2]), ("label2", [3, 4])]
    two = pd.DataFrame({"label1": [1, 2]}, index=pd.MultiIndex.from_tuples([("a", "chr1"), ("a", "chr2")]))
    assert [tuple(r) for r in reshape_for_gwas(spark, two).collect()] == [("chr1", "label1", [1]), ("chr2", "label1", [2])]


def test_header_blocks():
    assert Stage.parse("chr_X_block_12") == ("X", 12) and str(Stage("X", 12)) == "chr_X_block_12" and Stage.parse("all") == (None, None)
    assert new_headers("chr_1_block_3", [("alpha_0", "a"), ("alpha_1", "a")], 2) == ("chr_1", [6, 7], ["chr_1_block_3_alpha_0_label_a", "chr_1_block_3_alpha_1_label_a"])
    assert new_headers("chr_1", [("alpha_1", "b")], 2)[0::2] == ("all", ["chr_1_alpha_1_label_b"])
    assert new_headers("all", [("alpha_2", "b")], 3) == ("all", [2], ["alpha_2_label_b"])
    with pytest.raises(ValueError, match="names no header block"):
        Stage.parse("block_1")


@pytest.mark.parametrize("metric", ["r2", "log_loss"])
def test_tied_scores_take_the_largest_penalty(spark, metric):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last bit; the tie is one all the same, also where a score is not a number or infinite."""
    sign = 1 if metric == "r2" else -1
    rows = [("a", f"alpha_{i}", float(x)) for i, order in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (sign * 0.01,)]) for x in order]
    rows += [("b", "alpha_0", sign * 2.0), ("b", "alpha_2", sign * (2.0 - 1e-6)), ("c", "alpha_0", sign * float("inf")), ("c", "alpha_1", 1.0)]
    scores = spark.createDataFrame(rows, "label string, alpha string, score double").coalesce(1)
    best = {r["label"]: r["alpha"] for r in best_alphas(scores, {"alpha_0": 1.0, "alpha_1": 2.0, "alpha_2": 3.0}, metric).collect()}
    assert best == {"a": "alpha_1" if metric == "r2" else "alpha_2", "b": "alpha_0", "c": "alpha_0"}
    lean = [("d", "alpha_0", 0.1 + 0.2), ("d", "alpha_1", 0.3)] if metric == "r2" else [("d", "alpha_0", 0.3), ("d", "alpha_1", 0.1 + 0.2)]
    tied = best_alphas(spark.createDataFrame(lean, "label string, alpha string, score double"), {"alpha_0": 1.0, "alpha_1": 2.0}, metric)
    assert tied.first()["alpha"] == "alpha_1"


@pytest.mark.parametrize("test", ["linear", "LRT", "Firth"])
def test_fixed_phenotypes_give_the_same_tests(spark, test):
    """Phenotypes and covariates that are numpy arrays, of few kinds or many, give what columns of them give; they are no column of each row."""
    rng = np.random.default_rng(3)
    calls = [[[int(x), int(z)] for x, z in rng.integers(-1, 2, (60, 2))] for _ in range(12)] + [[[0, 1]] * 60]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, calls array<array<int>>")
    y = rng.normal(size=60) if test == "linear" else (rng.random(60) < 0.4).astype(float)
    gwas = linear_regression_gwas if test == "linear" else lambda *a, **k: logistic_regression_gwas(*a, test, **k)
    for second in (rng.integers(0, 3, 60), rng.normal(size=60)):
        covariates = np.column_stack([np.ones(60), second])
        filled = rows.select("i", fx.dosages(calls="calls").alias("d")).withColumn("y", F.array(*[F.lit(float(v)) for v in y]))
        want = {r["i"]: r["r"] for r in filled.where("d.varies").select("i", gwas("d.values", "y", covariates).alias("r")).collect()}
        frame = rows.select("i", gwas(None, y, covariates, dosages=fx.dosages(calls="calls")).alias("r"))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1 and "tested(dosages_of(" in plan
        got = {r["i"]: r["r"] for r in frame.collect()}
        assert got.pop(12) is None and got.keys() == want.keys()
        for i, r in got.items():
            flat = lambda s: np.hstack([np.ravel(v) for v in s])
            np.testing.assert_allclose(flat(r), flat(want[i]), rtol=2e-5, atol=1e-7)


@pytest.mark.parametrize("test", ["linear", "LRT", "Firth"])
def test_packed_calls_give_the_tests_of_their_dosages(spark, test):
    """Rows of packed calls, those that do not vary, that are nearly a covariate, or that are not even, are tested as their dosages are, in one worker."""

    rng = np.random.default_rng(5)
    n = 60
    y, calls = rng.integers(0, 2, n).astype(float), rng.choice([-1, 0, 1, 2], (7, n, 2), p=[0.1, 0.5, 0.3, 0.1]).astype(np.int8)
    calls[2], calls[3] = 1, -1
    m = np.column_stack([np.ones(n), np.where(np.minimum(calls[4, :, 0], calls[4, :, 1]) < 0, 1, calls[4].sum(1))]) if test == "linear" else np.column_stack([np.ones(n), rng.integers(0, 2, n)])
    rows = [(i, c.tobytes()) for i, c in enumerate(calls)] + [(7, None), (8, calls[0, : n - 1].tobytes())]
    f = lambda **k: linear_regression_gwas(None, y + np.arange(n) / 9, m, **k) if test == "linear" else logistic_regression_gwas(None, y, m, test, **k)
    df = spark.createDataFrame(rows[:-1], "i int, c binary").coalesce(1)
    got = {r.i: r for r in df.select("i", f(calls=F.col("c")).alias("a"), f(dosages=fx.dosages(calls="c")).alias("b")).collect()}
    flat = lambda r: np.array([x for v in r for x in (v if isinstance(v, list) else [v])])
    assert [i for i in range(8) if got[i].a is None] == [i for i in range(8) if got[i].b is None] == [2, 3, 7]
    for i in (0, 1, 4, 5, 6):
        assert flat(got[i].a) == pytest.approx(flat(got[i].b), rel=1e-7, abs=1e-10, nan_ok=True), i
    with pytest.raises(Exception, match="samples"):
        spark.createDataFrame(rows, "i int, c binary").coalesce(1).select(f(calls=F.col("c"))).collect()


@pytest.mark.parametrize("regression", [linear_regression, logistic_regression])
def test_values_may_be_made_where_they_are_tested(spark, regression):
    """The same rows as with a column of values, without those that do not vary, and no list of values in the plan."""
    from helixframe.stats import kernels

    rng = np.random.default_rng(6)
    calls = rng.integers(-1, 3, (9, 30, 2)).astype(np.int8)
    calls[4] = 1
    df = spark.createDataFrame([(str(i % 2), i, c.tobytes()) for i, c in enumerate(calls)], "contigName string, start int, c binary").coalesce(1)
    y = pd.DataFrame({"a": rng.integers(0, 2, 30).astype(float), "b": rng.integers(0, 2, 30).astype(float)})
    c = pd.DataFrame({"c": rng.normal(size=30)})
    want = regression(df.select("contigName", "start", fx.dosages(calls="c").alias("d")).where("d.varies").select("contigName", "start", "d.values"), y, c).toPandas()
    made = regression(df, y, c, values_column=kernels.Made(kernels.dosages, [F.col("c")], 2)).drop("c")
    assert "array<double>" not in made._jdf.queryExecution().analyzed().toString() and made.columns == list(want.columns)
    order = ["start", "phenotype"]
    pd.testing.assert_frame_equal(made.toPandas().sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), rtol=1e-9)
