"""Column functions against golden values."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe import functions as fx
from helixframe.stats import kernels

CALLS = "genotypes array<struct<calls:array<int>>>"


def genotypes(spark, *samples):
    return spark.createDataFrame([([(list(c),) for c in samples],)], CALLS)


def stats(spark, *samples):
    return genotypes(spark, *samples).select(fx.expand_struct(fx.call_summary_stats("genotypes"))).first()


def test_call_summary_stats(spark):
    assert stats(spark, [0, 0], [1, 0], [1, 1]) == Row(1.0, 3, 0, 1, [1, 1], 2, 6, [3, 3], [0.5, 0.5])
    assert stats(spark, []) == Row(0.0, 0, 1, 0, [], 0, 0, [], [])
    assert stats(spark, [0]) == Row(1.0, 1, 0, 0, [1], 0, 1, [1], [1.0])
    half = stats(spark, [0, -1], [2, 2])
    assert (half.nCalled, half.nUncalled, half.nHomozygous, half.alleleCounts, half.nNonRef) == (1, 1, [1, 0, 1], [1, 0, 2], 1)
    assert stats(spark, [-1, -1]).nAllelesCalled == 0
    assert genotypes(spark).select(fx.call_summary_stats("genotypes").alias("s")).first().s.nCalled == 0


def test_hardy_weinberg(spark):
    r = genotypes(spark, [1, 1], [1, 0], [0, 0]).select(fx.expand_struct(fx.hardy_weinberg("genotypes"))).first()
    assert r.hetFreqHwe == pytest.approx(0.6) and r.pValueHwe == pytest.approx(0.7)
    many = [[0, 1]] * 110 + [[1, 1]] * 24 + [[0, 0]] * 570
    r = genotypes(spark, *many).select(fx.expand_struct(fx.hardy_weinberg("genotypes"))).first()
    assert r.hetFreqHwe == pytest.approx(0.19938860890353427, rel=1e-12) and r.pValueHwe == pytest.approx(2.875389500e-07, rel=1e-8)
    none = genotypes(spark, [-1, -1]).select(fx.expand_struct(fx.hardy_weinberg("genotypes"))).first()
    assert math.isnan(none.hetFreqHwe) and none.pValueHwe == 0.5


def test_kernels_equal_brute_force(spark):
    import random

    r = random.Random(4)
    ploidy = lambda: r.choice([0, 1, 2, 2, 2, 3])
    rows = [[[r.choice([-1, 0, 0, 1, 2]) for _ in range(ploidy() if uneven else 2)] for _ in range(r.randint(0, 9))] for uneven in (0, 1) for _ in range(30)]
    frame = spark.createDataFrame([(i, [(c,) for c in row]) for i, row in enumerate(rows)] + [(99, None), (100, [(None,), ([0, 1],)])], "i int, " + CALLS)
    got = {x.i: x for x in frame.select("i", fx.call_summary_stats("genotypes").alias("s"), fx.genotype_states("genotypes").alias("states")).collect()}
    assert got[99].s is None and got[99].states is None and got[100].states == [-1, 1] and got[100].s.nUncalled == 1
    for i, row in enumerate(rows):
        s, known = got[i].s, [[a for a in c if a >= 0] for c in row]
        called = [c for c in row if c and min(c) >= 0]
        flat = [a for c in known for a in c]
        only = [c[0] for c in known if len(set(c)) == 1]
        assert (s.nCalled, s.nUncalled, s.nHet, s.nNonRef, s.nAllelesCalled) == (len(called), len(row) - len(called), sum(len(set(c)) > 1 for c in known), sum(any(c) for c in known), len(flat))
        assert s.alleleCounts == [flat.count(a) for a in range(max(flat, default=-1) + 1)] and s.nHomozygous == [only.count(a) for a in range(max(only, default=-1) + 1)]
        assert got[i].states == [sum(c) if c and min(c) >= 0 else -1 for c in row]


def test_array_summary_stats(spark):
    one = lambda values: spark.createDataFrame([(values,)], "a array<double>").select(fx.expand_struct(fx.array_summary_stats("a"))).first()
    assert one([1.0, 2.0, 3.0]) == Row(2.0, 1.0, 1.0, 3.0)
    assert one([None, 5.0, None, 7.0]) == Row(6.0, math.sqrt(2), 5.0, 7.0)
    assert one([]) == Row(None, None, None, None) and one([None]) == Row(None, None, None, None)
    r = one([4.0])
    assert (r.mean, r.min, r.max) == (4.0, 4.0, 4.0) and math.isnan(r.stdDev)
    df = spark.createDataFrame([([(3,), (None,), (5,)],)], "genotypes array<struct<depth:int>>")
    assert df.select(fx.expand_struct(fx.dp_summary_stats("genotypes"))).first().mean == 4.0


def test_mean_substitute(spark):
    one = lambda values, *m: spark.createDataFrame([(values,)], "a array<double>").select(fx.mean_substitute("a", *m).alias("m")).first().m
    assert one([float("nan"), None, -1.0, 1.0, 2.0, 3.0, 4.0]) == [2.5, 2.5, 2.5, 1, 2, 3, 4]
    assert one([0.0, 1.0, 2.0, 3.0, None, None]) == [0, 1, 2, 3, 1.5, 1.5]
    assert one([-1.0, None]) == [-1, -1] and one([5.0, 7.0, 9.0], 5) == [8, 7, 9] and one([]) == []


@settings(max_examples=20, deadline=None)
@given(values=st.lists(st.floats(-100, 100), min_size=1, max_size=20), q=st.floats(0, 1))
def test_array_quantile_is_linear_interpolation(spark, values, q):
    got = spark.createDataFrame([(values,)], "a array<double>").select(fx.array_quantile("a", q).alias("q")).first().q
    assert got == pytest.approx(float(np.quantile(values, q)), rel=1e-9, abs=1e-9)


def test_array_quantile_cases(spark):
    df = spark.createDataFrame([([5.0, 3.0, 1.0, 2.0, 4.0],), ([],)], "a array<double>")
    assert [r.q for r in df.select(fx.array_quantile("a", 0.7).alias("q")).collect()] == [pytest.approx(3.8), None]
    assert df.select(fx.array_quantile("a", 0.0, True).alias("q")).first().q == 5.0


def test_comb(spark):
    for n in (0, 1, 5, 44, 60):
        rows = spark.range(0, n + 2).select("id", fx.comb(F.lit(n), F.col("id")).alias("c")).collect()
        assert [r.c for r in rows] == [math.comb(n, r.id) for r in rows]


def test_genotype_states(spark):
    assert genotypes(spark, [0, 1], [1, 1], [-1, 0], [], [2, 1, 1]).select(fx.genotype_states("genotypes").alias("s")).first().s == [1, 2, -1, -1, 4]


HARD = [
    ([0.0, 0.0, 1.0], 1, [1, 1], False, None), ([0.1, 0.1, 0.8], 1, [-1, -1], False, None), ([0.1, 0.9, 0.8, 0.2], 1, [1, -1], True, None), ([0.1, 0.9, 0.8, 0.2], 1, [1, 0], True, 0.8),
    ([0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 2, [1, 2], True, 0.8), ([0.1, 0.9, 0.0, 0.1, 0.1, 0.8], 2, [1, 2], True, 0.8), ([0.1, 0.1, 0.8], 1, [1, 1], False, 0.8), ([0.0, 0.0, 0.0, 0.0, 1.0, 0.0], 2, [1, 2], False, None),
    ([0.0, 0.0, 0.0, 1.0, 0.0, 0.0], 2, [0, 2], False, None), ([0.0] * 7 + [1.0, 0.0, 0.0], 3, [1, 3], False, None), (None, 1, None, False, None), ([1.0, 2.0], None, None, False, None), ([1.0, 2.0], 1, None, None, None),
]


def test_hard_calls(spark):
    for p, alts, want, phased, threshold in HARD:
        df = spark.createDataFrame([(p, alts, phased)], "p array<double>, n int, phased boolean")
        assert df.select(fx.hard_calls("p", "n", "phased", *([threshold] if threshold else [])).alias("c")).first().c == want


def test_variant_type(spark):
    cases = [("A", "G", "Transition"), ("AC", "AT", "Transition"), ("A", "T", "Transversion"), ("AA", "TT", "Unknown"), ("A", "*", "SpanningDeletion"), ("A", "AT", "Insertion"), ("ATG", "AG", "Deletion"), ("AT", "A", "Deletion"), ("CAT", "CGGAT", "Insertion"), ("A", "TA", "Unknown"), ("A", "A", "Unknown")]
    df = spark.createDataFrame(cases, "r string, a string, want string")
    assert all(r.want == r.got for r in df.select("want", fx.variant_type("r", "a").alias("got")).collect())
    pairs = {"AG", "GA", "CT", "TC"}
    each = spark.createDataFrame([(a, b) for a in "ACGT" for b in "ACGT" if a != b], "r string, a string")
    assert all(r.k == ("Transition" if r.r + r.a in pairs else "Transversion") for r in each.select("r", "a", fx.variant_type("r", "a").alias("k")).collect())


def test_structs(spark):
    df = spark.createDataFrame([((1, "x"),), (None,)], "s struct<a:int,b:string>")
    assert df.select(fx.expand_struct("s")).collect() == [Row(a=1, b="x"), Row(a=None, b=None)]
    assert df.select(fx.subset_struct("s", "b").alias("t")).first().t == Row(b="x")
    assert df.select(fx.add_struct_fields("s", "c", F.lit(2), "d", "y").alias("t")).first().t == Row(a=1, b="x", c=2, d="y")
    assert df.agg(fx.expand_struct(F.max("s"))).first() == Row(a=1, b="x")


def test_vectors_and_matrices(spark):
    df = spark.createDataFrame([([1.0, 0.0, 3.0],)], "a array<double>")
    r = df.select(fx.array_to_dense_vector("a").alias("d"), fx.array_to_sparse_vector("a").alias("s")).first()
    assert r.d == Vectors.dense(1, 0, 3) and r.s == Vectors.sparse(3, {0: 1.0, 2: 3.0}) and r.s.indices.tolist() == [0, 2]
    assert df.select(fx.vector_to_array(fx.array_to_sparse_vector("a")).alias("x")).first().x == [1, 0, 3]
    m = spark.createDataFrame([(1, DenseMatrix(2, 3, [1, 2, 3, 4, 5, 6]))], ["id", "m"])
    assert [r[1] for r in m.select("id", fx.explode_matrix("m").alias("row")).collect()] == [[1, 3, 5], [2, 4, 6]]
    assert df.select(fx.matrix_literal(np.array([[1, 2], [3, 4]])).alias("m")).first().m == [[1, 2], [3, 4]]


def test_assert_true_or_error(spark):
    assert spark.range(1).select(fx.assert_true_or_error(F.lit(True), "no").alias("x")).first().x is None
    for bad in (F.lit(False), F.lit(None).cast("boolean")):
        with pytest.raises(Exception, match="it broke"):
            spark.range(1).select(fx.assert_true_or_error(bad, "it broke")).collect()


def test_regressions(spark):
    from helixframe.functions.regression import linear_regression_gwas, logistic_regression_gwas

    df = spark.createDataFrame([([0.0, 1.0, 2.0], [2.0, 3.0, 4.0], DenseMatrix(3, 1, [1.0, 1.0, 1.0]))], ["g", "y", "c"])
    for c in ("c", np.ones((3, 1))):
        r = df.select(fx.expand_struct(linear_regression_gwas("g", "y", c))).first()
        assert r.beta == pytest.approx(1) and r.standardError == pytest.approx(1.49e-8, rel=1e-2) and r.pValue == pytest.approx(9.49e-9, rel=1e-2)
    rng = np.random.default_rng(2)
    x, z = rng.integers(0, 3, 80).astype(float), rng.normal(size=80)
    y = (rng.random(80) < 1 / (1 + np.exp(-(0.8 * x - 0.5 + 0.3 * z)))).astype(float)
    c = np.column_stack([np.ones(80), z])
    df = spark.createDataFrame([(x.tolist(), y.tolist(), [0.1] * 80)], "g array<double>, y array<double>, o array<double>")
    lrt = df.select(fx.expand_struct(logistic_regression_gwas("g", "y", c, "LRT"))).first()
    firth = df.select(fx.expand_struct(logistic_regression_gwas("g", "y", c, "firth", "o"))).first()
    assert abs(firth.beta) < abs(lrt.beta) and lrt.waldConfidenceInterval[0] < lrt.oddsRatio < lrt.waldConfidenceInterval[1] and 0 < lrt.pValue < 1
    split = df.select(fx.expand_struct(logistic_regression_gwas("y", "y", c, "LRT"))).first()
    assert math.isnan(split.beta)  # a perfect separation has no fit
    with pytest.raises(ValueError):
        logistic_regression_gwas("g", "y", c, "score")


def test_dosages_are_filled_states(spark):
    import random

    from helixframe import functions as fx

    r = random.Random(4)
    calls = lambda: r.choice([[0, 0], [0, 1], [1, 1], [-1, 0], [], None, [1], [2, 1]])
    rows = [([(calls(),) for _ in range(r.randint(0, 6))],) for _ in range(60)] + [(None,), ([],), ([([-1, -1],)] * 3,), ([([0, 1],)] * 3,)]
    df = spark.createDataFrame(rows, "g array<struct<calls:array<int>>>").select(fx.dosages("g").alias("d"), fx.mean_substitute(fx.genotype_states("g")).alias("want"))
    for x in df.select("d.values", "d.varies", "want").collect():
        assert x["values"] == x.want and (x.want is None or x.varies == (len(set(x.want)) > 1))


def test_even_arrays_have_the_statistics_of_uneven_ones():
    """Rows of one length take a shorter way; a row of another length beside them makes them take the general one."""
    r = np.random.default_rng(5)
    for alleles in (1, 2, 3, 12):
        calls = r.integers(-1, alleles, (9, 40, 2))
        calls[0], calls[1], calls[2, :, 1] = -1, 0, -1
        even = pa.array(calls.tolist(), pa.list_(pa.list_(pa.int32())))
        uneven = pa.array([*calls.tolist(), [[0, 0]]], even.type)
        assert kernels.pair_counts(even) is not None and kernels.pair_counts(uneven) is None
        assert kernels.states(even).to_pylist() == kernels.states(uneven).to_pylist()[:-1]
        for kernel in (kernels.call_summary_stats, kernels.hardy_weinberg, kernels.dosages):
            one, two = kernel(even).to_pylist(), kernel(uneven).to_pylist()[:-1]
            for a, b in zip(one, two, strict=True):
                assert repr(a) == repr(b) or all(np.allclose(a[k], b[k], rtol=1e-12, atol=0, equal_nan=True) for k in a), (a, b)
    numbers = [[None if x % 5 == 0 else x - 40 for x in row] for row in r.integers(0, 100, (6, 30)).tolist()]
    numbers += [[None] * 30, [7, *[None] * 29], [3] * 30]
    for some in (numbers, [[-(2**31), *[2**31 - 1] * 29]]):
        one, two = (kernels.array_summary_stats(pa.array(x, pa.list_(pa.int32()))).to_pylist() for x in (some, [*some, [1]]))
        for a, b in zip(one, two[:-1], strict=True):
            assert all(a[k] is b[k] is None or np.isclose(a[k], b[k], rtol=1e-12, atol=1e-7, equal_nan=True) for k in a), (a, b)
