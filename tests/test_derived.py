"""The genotypes that registered queries are made of."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.plans import derived, registered
from helixframe.plans.registered import QUERIES
from helixframe.stats import kernels


def tables(spark, folder, parts, samples):
    spark.range(parts).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50).cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")
    spark.range(samples).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_genotypes_are_those_of_the_rule(spark, tmp_path):
    d = tables(spark, tmp_path, 90, 70)
    rows = derived.variants(spark, d).collect()
    assert len(rows) == 90
    for r in rows:
        a, k = r["start"] // 50, len(r["alternateAlleles"]) + 1
        for b, g in enumerate(r["genotypes"]):
            none = (a + b) % 17 == 0
            calls = [-1 if none or (a + b) % 19 == 0 else (a * 7 + b * 13) % k, -1 if none else (a * 5 + b * 3 + 1) % k]
            assert (g["sampleId"], g["calls"], g["depth"], g["conditionalQuality"]) == (f"S{b}", calls, None if a * b % 23 == 0 else a * b % 60, (a + 3 * b) % 100)
    some = derived.variants(spark, d, "calls", "sampleId")
    assert some.schema["genotypes"].dataType.elementType.fieldNames() == ["sampleId", "calls"]
    assert [[(g["sampleId"], g["calls"]) for g in r["genotypes"]] for r in some.orderBy("start").collect()] == [[(g["sampleId"], g["calls"]) for g in r["genotypes"]] for r in sorted(rows, key=lambda r: r["start"])]
    assert "transform" not in some._jdf.queryExecution().executedPlan().toString()  # not made a genotype at a time


def test_no_samples(spark, tmp_path):
    assert [r["genotypes"] for r in derived.variants(spark, tables(spark, tmp_path, 3, 0)).collect()] == [[]] * 3


def test_types_are_counted_without_genotypes(spark, tmp_path, monkeypatch):
    """Tasks, and what they report to the driver, do not grow with the genotypes that the query does not look at."""
    monkeypatch.setattr(derived, "CELLS", 10)
    plan = QUERIES["variant_type_counts"](spark, tables(spark, tmp_path, 90, 70))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "supplier" not in plan


@pytest.mark.parametrize("name", ["call_stats_alleles", "genotype_states", "mean_substitute", "split_multiallelic_rows"])
def test_genotypes_are_made_once(spark, tmp_path, name):
    """The filter that an explode implies does not make genotypes a second time, below the exchange that deals sites to tasks."""
    plan = QUERIES[name](spark, tables(spark, tmp_path, 90, 70))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [made(") == 1
    if name != "split_multiallelic_rows":
        assert plan.count("ArrowEvalPython [call_stats_of(") + plan.count("ArrowEvalPython [states_of(") + plan.count("substituted_of(states_of(") == 1


@pytest.mark.parametrize("name", ["call_summary_stats", "hardy_weinberg", "dp_summary_stats", "gq_summary_stats"])
def test_genotypes_stay_in_the_worker_of_their_statistics(spark, tmp_path, name):
    """Genotypes that a statistic alone looks at are not sent through the JVM: one evaluation holds both kernels."""
    plan = QUERIES[name](spark, tables(spark, tmp_path, 90, 70))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "_of(made(" in plan


def test_states_of_blocks_stay_in_the_worker(spark, tmp_path, monkeypatch):
    plans = []
    blocks = registered.block_variants_and_samples
    monkeypatch.setattr(registered, "block_variants_and_samples", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or blocks(df, *a))
    QUERIES["block_matrix"](spark, tables(spark, tmp_path, 90, 70))
    assert plans[0].count("ArrowEvalPython [") == 1 and "states_of(made(" in plans[0]


@pytest.mark.parametrize("name", ["sample_call_stats", "sample_dp_stats", "sample_gq_stats", "sql_sample_call_stats", "sql_sample_dp_stats", "sql_sample_gq_stats"])
def test_sums_of_samples_are_few_rows(spark, tmp_path, monkeypatch, name):
    """Genotypes are made and added up in one worker, some rows at a time, and tasks, each of which gives a row for each sample, do not grow in number with the genotypes."""
    d = tables(spark, tmp_path, 90, 70)
    plain = sorted(QUERIES[name](spark, d).collect(), key=str)
    monkeypatch.setattr(derived, "CELLS", 200)  # two rows at a time
    monkeypatch.setattr(derived, "KEPT_CELLS", 200)
    small = QUERIES[name](spark, d)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [made(" not in plan
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(key#\d+L, (\d+)\)", plan)]
    assert all(n <= derived.ROUNDS * spark.sparkContext.defaultParallelism for n in dealt)
    assert sorted(small.collect(), key=str) == plain and len(plain) == 70


def test_sums_of_samples_count_any_calls_and_nulls():
    """The quick ways for even rows and the ways for all others give the same sums."""
    rng = np.random.default_rng(0)
    calls, kinds = rng.integers(-1, 4, (80, 7, 2)).tolist(), [[["Transition", "Insertion", None][i % 3], "Unknown"][: i % 3] for i in range(80)]
    column, types = pa.array(calls, pa.list_(pa.list_(pa.int32()))), pa.array(kinds, pa.list_(pa.string()))
    _, place, counts = kernels.sample_counts(column, types)
    assert kernels.place_counts(column, types).tolist() == [np.bincount(place, c, 7).tolist() for c in counts]
    depths = [[None if rng.random() < 0.3 or b == 3 else int(rng.integers(-5, 1 << 30)) for b in range(6)] for _ in range(40)]
    uneven = [*depths, [1], None, []]
    for rows in (depths, uneven):
        held = [[r[b] for r in rows if r and len(r) > b and r[b] is not None] for b in range(6)]
        n, total, up, down, low, high = kernels.place_sums(pa.array(rows, pa.list_(pa.int32()))).tolist()
        squares = [(u << 32) + d for u, d in zip(up, down)]
        assert n == [len(h) for h in held] and total == [sum(h) for h in held] and squares == [sum(x * x for x in h) for h in held]
        assert [x for x, h in zip(low, held) if h] == [min(h) for h in held if h] and [x for x, h in zip(high, held) if h] == [max(h) for h in held if h]


def test_packed_calls_give_the_same(monkeypatch):
    """Packed calls, whole or in slices of a few rows, give what lists of calls give; uneven and null ones too."""
    rng = np.random.default_rng(3)
    even = rng.integers(-1, 3, (13, 40, 2))
    for rows in (even.tolist(), [*even[:3].tolist(), None, even[0, :7].tolist(), []]):
        column = pa.array(rows, pa.list_(pa.list_(pa.int32())))
        packed = pa.array([None if r is None else np.array(r, np.int8).tobytes() for r in rows], pa.binary())
        whole = {f: getattr(kernels, f)(column).to_pylist() for f in ("states", "dosages", "call_summary_stats", "hardy_weinberg")}
        for stretch in (kernels.STRETCH, 90):
            monkeypatch.setattr(kernels, "STRETCH", stretch)
            for f, want in whole.items():
                got = [str(getattr(kernels, f)(x).to_pylist()) for x in (column, packed, packed.slice(0, len(rows)))]
                assert got == [str(want)] * 3, f
                assert str(getattr(kernels, f)(packed.slice(1)).to_pylist()) == str(want[1:])
        monkeypatch.undo()


def test_calls_pass_the_jvm_as_one_value_of_a_row(spark, tmp_path):
    plan = QUERIES["call_stats_alleles"](spark, tables(spark, tmp_path, 90, 70))._jdf.queryExecution().analyzed().toString()
    assert "array<array<int>>" not in plan and "genotypes" not in plan
    assert dict(derived.variants_packed(spark, str(tmp_path)).dtypes)["calls"] == "binary"


def test_long_rows_are_counted_and_tested_by_their_tails(monkeypatch):
    """Pairs compared one after the other, and counts of heterozygotes that are no likelier alone, give what all of them give."""
    rng = np.random.default_rng(4)
    each = np.concatenate([rng.choice(4, (6, 900, 2), p=p).astype(np.int8) - 1 for p in ([0.1, 0.5, 0.4, 0], [0.02, 0.9, 0.05, 0.03], [0, 0.3, 0.3, 0.4])])
    each[3], each[4] = -1, 0
    column, functions = pa.array([r.tobytes() for r in each], pa.binary()), ("call_summary_stats", "hardy_weinberg", "dosages")
    whole = [getattr(kernels, f)(column).to_pylist() for f in functions]
    monkeypatch.setattr(kernels, "LONG_ROW", 1)
    monkeypatch.setattr(kernels, "ALL_HETS", 0)
    for f, want in zip(functions, whole):
        got = getattr(kernels, f)(column).to_pylist()
        if f == "hardy_weinberg":
            assert [r["pValueHwe"] for r in got] == pytest.approx([r["pValueHwe"] for r in want], rel=1e-12, abs=0)
        else:
            assert str(got) == str(want)
    factorials = kernels._log_factorials(1 << 12)
    assert len(kernels._no_likelier_hets(1000, 900, 1100, 900, factorials)) < 30  # not all 451


@pytest.mark.parametrize("name", ["call_summary_stats", "hardy_weinberg"])
def test_calls_of_statistics_are_packed(spark, tmp_path, name):
    plan = QUERIES[name](spark, tables(spark, tmp_path, 90, 70))
    assert "array<array<int>>" not in plan._jdf.queryExecution().analyzed().toString()
    rows, calls = derived.sites_with(spark, str(tmp_path), "calls")
    assert rows.select(calls.alias("c")).dtypes == [("c", "binary")]


def test_packed_calls_are_split_as_lists_are(spark, tmp_path):
    from helixframe.functions.genotypes import call_sums
    from helixframe.operators.split_multiallelics import split_multiallelics

    d = tables(spark, tmp_path, 90, 70)
    keys = ["start", "alternateAlleles", "splitFromMultiAllelic"]
    lists = {str([r[k] for k in keys]): [g["calls"] for g in r["genotypes"]] for r in split_multiallelics(derived.variants(spark, d, "calls")).collect()}
    split = split_multiallelics(derived.variants_packed(spark, d))
    rows = split.select(*keys, "calls", call_sums("calls").alias("s")).collect()
    assert {str([r[k] for k in keys]): np.frombuffer(r["calls"], np.int8).reshape(-1, 2).tolist() for r in rows} == lists and len(lists) > 90
    for r in rows:
        c = np.array(lists[str([r[k] for k in keys])])
        assert tuple(r["s"]) == (c[:, 0].sum(), c[:, 1].sum(), (c[:, 0] * np.arange(1, 71)).sum())
    assert "array<array<int>>" not in QUERIES["split_multiallelic_rows"](spark, d)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rows", [[[1, 2, 3], [4, 5, 6]], [[1, None, 3], [4, 5, 6]], [[1], None, [], [4, 5]]])
def test_places_are_turned(spark, monkeypatch, rows):
    """The same rows as posexplode's; a place's values stand together where arrays are of one length."""
    monkeypatch.setattr(derived, "TURNED", 2)
    df = spark.createDataFrame(list(enumerate(rows)), "k int, a array<int>").coalesce(1)
    turned = [tuple(r) for r in derived.turned_places(df, ["k"], F.col("a"), "at", "x").collect()]
    assert sorted(turned, key=str) == sorted(((k, i, x) for k, r in enumerate(rows) for i, x in enumerate(r or [])), key=str)
    if None not in rows:
        assert [at for _, at, _ in turned] == [0, 0, 1, 1, 2, 2]


def test_moments_of_even_doubles(monkeypatch):
    """Arrays of one length give what they give one by one beside others; nulls, NaN, infinities and single elements too."""
    rng = np.random.default_rng(7)
    for rows in (rng.normal(size=(5, 8)).tolist(), [[1.0], [2.0]], [[1.0, float("nan")], [2.0, 3.0]], [[1.0, None], [2.0, 3.0]], [[1.0, float("inf")], [2.0, 3.0]]):
        column = pa.array(rows, pa.list_(pa.float64()))
        quick = kernels.even_moments(column)
        plain = not any(x is None or x != x for r in rows for x in r)
        assert (quick is not None) == plain
        want = kernels.array_summary_stats(pa.array([*rows, []], pa.list_(pa.float64()))).to_pylist()[:-1]
        for a, b in zip(kernels.array_summary_stats(column).to_pylist(), want):
            np.testing.assert_allclose([*a.values()], [*b.values()], rtol=1e-12)
