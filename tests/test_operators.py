"""DataFrame operators: sample statistics, joins, splitting, blocks, normalization, liftover, pipe."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.operators import registry
from helixframe.operators.blocks import block_variants_and_samples
from helixframe.operators.lift_over import lift_over_variants
from helixframe.operators.normalize_variants import normalize_variants
from helixframe.operators.overlap_join import left_overlap_join, left_semi_overlap_join
from helixframe.operators.pipe import pipe, pipe_cleanup
from helixframe.operators.sample_stats import merge_variants, sample_call_summary_stats, sample_dp_summary_stats
from helixframe.operators.split_multiallelics import split_multiallelics


def test_sample_call_stats(spark):
    rows = [("T", ["C"], [("a", [0, 0])]), ("AT", ["A"], [("a", [0, 1])]), ("G", ["A"], [("a", [1, 1])])]
    df = spark.createDataFrame(rows, "referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,calls:array<int>>>")
    r = sample_call_summary_stats(df).select(F.inline("sample_call_summary_stats")).first()
    assert (r.sampleId, r.nHomRef, r.nHet, r.nHomVar, r.nSnp, r.nDeletion, r.nInsertion) == ("a", 1, 1, 1, 2, 1, 0)
    assert r.rTiTv == float("inf") and r.rInsertionDeletion == 0 and r.rHetHomVar == 1 and r.callRate == 1


def test_sample_depth_stats(spark):
    df = spark.createDataFrame([("x", [(1,), (None,)]), ("x", [(3,), (5,)]), ("y", [(2,), (2,)])], "k string, genotypes array<struct<depth:int>>")
    rows = {r.k: r.sample_dp_summary_stats for r in sample_dp_summary_stats(df, by=["k"]).collect()}
    assert rows["x"][0].mean == 2 and rows["x"][1].mean == 5 and rows["x"][1].stdDev != rows["x"][1].stdDev


INTERVAL = "name string, contigName string, start long, end long"


def naive(left, right, how):
    on = (left.start < right.end) & (right.start < left.end) & (left.contigName == right.contigName)
    return left.join(right, on, how)


@pytest.mark.parametrize("bin_size", [1, 3, 50])
def test_overlap_join_equals_the_naive_plan(spark, bin_size):
    r = random.Random(bin_size)

    def some(n, tag):
        out = []
        for i in range(n):
            s = r.randint(0, 60)
            out.append((f"{tag}{i}", r.choice(["1", "2", None]), r.choice([s, s, s, None]), r.choice([s + 1, s + 1, s + r.randint(0, 20), s - r.randint(0, 3), None])))
        return spark.createDataFrame(out + out[:3], INTERVAL)

    left, right = some(60, "l"), some(40, "r")
    wanted = naive(left, right, "left").collect()
    got = left_overlap_join(left, right, bin_size=bin_size).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(map(tuple, got)) == key(map(tuple, wanted))
    assert key(map(tuple, left_semi_overlap_join(left, right, bin_size=bin_size).collect())) == key(map(tuple, naive(left, right, "left_semi").collect()))


def test_overlap_join_names_and_defaults(spark):
    left = spark.createDataFrame([(1, 10)], "start long, end long")
    right = spark.createDataFrame([(2, 3)], "s long, e long")
    with pytest.raises(ValueError):
        left_overlap_join(left, right)
    got = left_overlap_join(left, right, right_start=right.s, right_end=right.e, right_prefix="r_")
    assert got.columns == ["start", "end", "r_s", "r_e"] and got.collect() == [Row(1, 10, 2, 3)]
    assert left_overlap_join(left, right, right_start=right.s, right_end=right.e, extra_join_expr=left.start == right.s).first()[2] is None


def test_overlap_join_is_an_equi_join(spark):
    schema = "contigName string, start long, end long"
    left, right = spark.createDataFrame([("1", 1, 2)], schema), spark.createDataFrame([("1", 1, 2)], schema)
    plan = left_overlap_join(left, right, right_prefix="r_")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_split_multiallelics(spark):
    g = "struct<sampleId:string,calls:array<int>,depth:int,alleleDepths:array<int>,phredLikelihoods:array<int>,odd:array<int>>"
    df = spark.createDataFrame(
        [("20", 100, 102, "AT", ["A", "ATT"], [1, 2], [("s", [0, 1], 7, [2, 15, 31], [2407, 0, 533, 697, 822, 574], [1, 2])]), ("20", 5, 6, "A", ["C"], [4], [("s", [1, 1], 3, [1, 2], [9, 8, 7], [5])])],
        f"contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, INFO_AC array<int>, genotypes array<{g}>",
    )
    df = df.withMetadata("INFO_AC", {"vcf_header_count": "A"})
    rows = split_multiallelics(df).orderBy("start", F.desc("alternateAlleles")).collect()
    one, b, a = rows[0], rows[1], rows[2]
    assert one.splitFromMultiAllelic is False and one.INFO_OLD_MULTIALLELIC is None and one.genotypes[0].phredLikelihoods == [9, 8, 7] and one.genotypes[0].odd == [5]
    assert a.alternateAlleles == ["A"] and a.INFO_AC == [1] and a.INFO_OLD_MULTIALLELIC == "20:101:AT/A/ATT"
    assert (a.genotypes[0].calls, a.genotypes[0].alleleDepths, a.genotypes[0].phredLikelihoods) == ([0, 1], [2, 15], [2407, 0, 533])
    assert (b.genotypes[0].calls, b.genotypes[0].alleleDepths, b.genotypes[0].phredLikelihoods, b.genotypes[0].depth, b.genotypes[0].odd) == ([0, -1], [2, 31], [2407, 697, 574], 7, None)


@pytest.mark.parametrize("ploidy", [1, 2, 3, 4])
def test_likelihood_places_for_any_ploidy(spark, ploidy):
    from itertools import combinations_with_replacement

    from helixframe.operators.split_multiallelics import kept_likelihoods

    for alts in (2, 3, 5):
        order = sorted(combinations_with_replacement(range(alts + 1), ploidy), key=lambda g: g[::-1])
        for allele in range(1, alts + 1):
            want = [i for i, g in enumerate(order) if set(g) <= {0, allele}]
            got = spark.range(1).select(kept_likelihoods(F.lit(ploidy), F.lit(allele)).alias("k")).first().k
            assert got == want, (ploidy, alts, allele)


def test_blocks(spark):
    rows = [("1", i, "A", ["C"], [float((i + k) % 3) for k in range(7)]) for i in range(5)] + [("1", 9, "A", ["C"], [2.0] * 7), ("2", 1, "G", ["T", "C"], [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "contigName string, start long, referenceAllele string, alternateAlleles array<string>, values array<double>")
    out = block_variants_and_samples(df, 2, 3).collect()
    assert len(out) == 18 and {r.header_block for r in out} == {"chr_1_block_0", "chr_1_block_1", "chr_1_block_2", "chr_2_block_0"}
    first = {r.sample_block: r for r in out if r.header == "1:0:A:C"}
    assert [first[s]["size"] for s in "123"] == [2, 3, 2] and sum((first[s]["values"] for s in "123"), []) == rows[0][4]
    assert first["1"].mu == pytest.approx(sum(rows[0][4]) / 7) and [r.header for r in out if r.header.startswith("2:")][0] == "2:1:G:T:C"
    with pytest.raises(Exception, match="inconsistent number of values"):
        block_variants_and_samples(df.union(spark.createDataFrame([("1", 3, "A", ["C"], [1.0])], df.schema)), 2, 3).collect()


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    a = "GATTTCCAAAAAGTC" + "ACGT" * 10
    (d / "r.fa").write_text(">c1 first\n" + "\n".join(a[i : i + 10] for i in range(0, len(a), 10)) + "\n>c2\nTTTT\n")
    n = len(a)
    (d / "x.chain").write_text(f"chain 100 old {n} + 0 {n} c1 {n} + 0 {n} 1\n{n}\n\nchain 50 rev {n} + 0 {n} c1 {n} - 0 {n} 2\n{n}\n\nchain 9 gap 30 + 0 30 c1 {n} + 0 32 3\n10 0 2\n20\n\n")
    return d, a


SITE = "contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>"


def test_normalize(spark, genome):
    d, a = genome
    rows = [("c1", 10, 12, "AA", ["A"]), ("c1", 0, 1, "G", ["C"]), ("c1", 7, 9, "AA", ["AAA"]), ("c1", 3, 5, "", ["A"]), ("c1", 2, 5, "TTT", None), ("c1", 4, 6, "TC", ["TG"])]
    df = spark.createDataFrame(rows, SITE)
    out = normalize_variants(df, str(d / "r.fa")).collect()
    assert (out[0].start, out[0].referenceAllele, out[0].alternateAlleles) == (6, "CA", ["C"]) and out[0].normalizationStatus.changed
    assert (out[1].start, out[1].normalizationStatus.changed) == (0, False)
    assert (out[2].start, out[2].referenceAllele, out[2].alternateAlleles) == (6, "C", ["CA"])
    assert out[3].normalizationStatus.errorMessage == "No REF or ALT alleles found." and out[3].start == 3
    assert (out[4].referenceAllele, out[4].normalizationStatus.changed) == ("T", True)
    assert (out[5].start, out[5].referenceAllele, out[5].alternateAlleles) == (5, "C", ["G"])
    assert "normalizationResult" in normalize_variants(df, str(d / "r.fa"), replace_columns=False).columns
    assert registry.transform("normalizeVariants", df, referenceGenomePath=str(d / "r.fa"), mode="split_and_normalize").count() == 5


def test_lift_over(spark, genome):
    from helixframe.functions.genome import lift_over_coordinates

    d, a = genome
    n = len(a)
    df = spark.createDataFrame([("old", 3, 8), ("rev", 3, 8), ("gap", 8, 12), ("gap", 12, 15), ("none", 1, 2), ("old", None, 2)], "c string, s long, e long")
    got = [r[0] for r in df.select(lift_over_coordinates("c", "s", "e", str(d / "x.chain"))).collect()]
    assert got == [Row(contigName="c1", start=3, end=8), Row(contigName="c1", start=n - 8, end=n - 3), Row(contigName="c1", start=8, end=14), Row(contigName="c1", start=14, end=17), None, None]
    rows = [("old", 0, 1, "G", ["C"]), ("old", 0, 1, "C", ["G"]), ("old", 0, 1, "A", ["T"]), ("rev", n - 1, n, "C", ["T"]), ("gap", 8, 12, "AAAA", ["A"]), ("new", 1, 2, "A", ["T"])]
    g = spark.createDataFrame([(*r, [0.25], [1, 2], [([0, 1], [5, 6])]) for r in rows], SITE + ", INFO_AF array<double>, INFO_X array<int>, genotypes array<struct<calls:array<int>,alleleDepths:array<int>>>")
    out = lift_over_variants(g, str(d / "x.chain"), str(d / "r.fa")).collect()
    assert out[0].liftOverStatus.success and not out[0].INFO_SwappedAlleles
    assert out[1].INFO_SwappedAlleles and (out[1].referenceAllele, out[1].alternateAlleles, out[1].INFO_AF, out[1].INFO_X) == ("G", ["C"], [0.75], [2, 1])
    assert (out[1].genotypes[0].calls, out[1].genotypes[0].alleleDepths) == ([1, 0], [6, 5])
    assert out[2].liftOverStatus.errorMessage.startswith("MismatchedRefAllele") and out[2].contigName == "old"
    assert out[3].INFO_ReverseComplementedAlleles and (out[3].start, out[3].referenceAllele, out[3].alternateAlleles) == (0, "G", ["A"])
    assert not out[4].liftOverStatus.success and out[5].liftOverStatus.errorMessage == "NoTarget"


def test_rows_that_lack_fields(spark, genome):
    from helixframe.functions.genome import normalize_variant

    d, _ = genome
    rows = [("old", 0, 1, "G", None), (None, 0, 1, "G", ["C"]), ("old", None, 1, "G", ["C"]), ("old", 0, None, "G", ["C"]), ("old", 0, 1, None, ["C"]), ("old", 0, 1, "G", ["C"])]
    df = spark.createDataFrame(rows, SITE).coalesce(1)
    out = lift_over_variants(df, str(d / "x.chain"), str(d / "r.fa")).collect()
    assert [tuple(r)[:5] for r in out[:5]] == rows[:5] and out[5].liftOverStatus.success
    assert [r.liftOverStatus.errorMessage.partition(": ")[2] for r in out[:5]] == ["alternateAlleles", "contigName", "start", "end", "referenceAllele"]
    done = [r[0] for r in df.select(normalize_variant("contigName", "start", "end", "referenceAllele", "alternateAlleles", str(d / "r.fa"))).collect()]
    assert done[1:5] == [None] * 4 and done[0] is not None
    assert [tuple(r)[:5] for r in normalize_variants(df, str(d / "r.fa")).collect()][1:5] == rows[1:5]


@pytest.mark.parametrize("rows_in_all", [1_000_000, 0])  # right's intervals all at the lowest level, and each at its own
def test_overlap_join_of_intervals_of_all_lengths(spark, monkeypatch, rows_in_all):
    import random

    from helixframe.operators import overlap_join

    monkeypatch.setattr(overlap_join, "ROWS_IN_ALL", rows_in_all)
    monkeypatch.setattr(overlap_join, "ROWS_EACH", 1)
    r = random.Random(rows_in_all)
    side = lambda n: [(i, str(r.randint(0, 1)), s := r.randint(-10**6, 10**7), s + int(10 ** r.uniform(-1, 7.5))) for i in range(n)] + [(n, None, 1, 5), (n + 1, "0", None, 5), (n + 2, "0", 7, 7), (n + 3, "0", 9, 3), (n + 4, "1", -(2**62), 2**62)]
    one, two = side(150), side(150)
    left, right = (spark.createDataFrame(x, "id long, contigName string, start long, end long") for x in (one, two))
    hit = lambda x, y: None not in (*x, *y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3]
    want = sorted([(x[0], y[0]) for x in one for y in two if hit(x, y)] + [(x[0], -1) for x in one if not any(hit(x, y) for y in two)])
    got = left_overlap_join(left, right, right_prefix="r_", bin_size=50)
    assert sorted((x.id, -1 if x.r_id is None else x.r_id) for x in got.collect()) == want
    assert sorted(x.id for x in left_semi_overlap_join(left, right, bin_size=50).collect()) == sorted({i for i, j in want if j >= 0})


def test_overlap_join_deals_long_intervals_to_few_bins(spark):
    from helixframe.operators import overlap_join as o

    first, last = F.col("id") * 977, F.col("id") * 977 + F.pow(F.lit(1.07), F.col("id")).cast("long")
    level = o._level(first, last, 5000)
    rows = spark.range(400).select(F.size(o._dealt(first, last, level, 5000, level)).alias("n"), level.alias("level"))
    assert rows.agg(F.max("n")).first()[0] <= o.FANOUT and rows.agg(F.max("level")).first()[0] == o.LEVELS - 1
    top, levels = o._lowest(spark.range(100), F.col("id") * 10, F.col("id") * 10 + 100_000_000, 5000)
    assert (top, levels) == (0, [4])  # 100 intervals of 20,000 bins are too many to stay lowest


def test_overlap_join_of_a_table_that_changes(spark):
    left = spark.range(300).selectExpr("'1' AS contigName", "id * 7 AS start", "id * 7 + id % 90 AS end", "id", "rand() AS noise").repartition(5)
    right = spark.range(200).selectExpr("'1' AS contigName", "id * 11 AS start", "id * 11 + 4 AS end", "id AS gene")
    ends = {i: (i * 7, i * 7 + i % 90) for i in range(300)}
    want = sorted((i, g) for i, (s, e) in ends.items() for g in range(200) if s < g * 11 + 4 and g * 11 < e)
    got = left_overlap_join(left, right, right_prefix="r_", bin_size=16).collect()
    assert sorted((r.id, r.r_gene) for r in got if r.r_gene is not None) == want
    assert sorted(r.id for r in got if r.r_gene is None) == sorted(set(range(300)) - {i for i, _ in want})
    assert sorted(r.id for r in left_semi_overlap_join(left, right, bin_size=16).collect()) == sorted({i for i, _ in want})


def test_merge(spark):
    a = spark.createDataFrame([("1", 1, 2, "A", ["C"], 5, [("s2", [0, 1])])], SITE + ", INFO_DP int, genotypes array<struct<sampleId:string,calls:array<int>>>")
    b = spark.createDataFrame([("1", 1, 2, "A", ["C"], 6, [("s1", [1, 1])]), ("1", 7, 8, "A", ["C"], 1, [("s1", [0, 0])])], a.schema)
    rows = merge_variants([a, b], sums={"INFO_DP": "INFO_DP"}).orderBy("start").collect()
    assert [g.sampleId for g in rows[0].genotypes] == ["s1", "s2"] and rows[0].INFO_DP == 11 and len(rows[1].genotypes) == 1


def test_merge_where_genotypes_are_made(spark):
    """The same as merge_variants, samples in several cohorts and sites in some of them too; only sites are shuffled."""
    from helixframe.functions.genotypes import field_totals
    from helixframe.operators.sample_stats import merge_made
    from helixframe.stats.kernels import Made

    def made(add: int, n: int) -> Made:
        kernel = lambda key: pa.array([[None if (k + b) % 5 == 0 else (k * 3 + b * add) % 11 for b in range(n)] for k in key.to_pylist()], pa.list_(pa.int32()))
        return Made(kernel, [F.col("key")], 1)

    names = [["s10", "s2", "s1"], ["s2", "t", "s2", "s1"], ["u"]]
    rows = [spark.range(low, 30).selectExpr("'1' AS contigName", "id AS start", "id + 1 AS end", "'A' AS referenceAllele", "array('C') AS alternateAlleles", "id AS key") for low in (0, 10, 25)]
    cohorts = [(df, said, made(i + 1, len(said))) for i, (df, said) in enumerate(zip(rows, names))]
    frames = []
    for df, said, how in cohorts:
        entry = F.arrays_zip(F.array(*[F.lit(x) for x in said]).alias("sampleId"), F.arrow_udf(how.kernel, "array<int>")("key").alias("depth"))
        frames.append(df.select("*", F.transform(entry, lambda x: F.struct(x["sampleId"].alias("sampleId"), x["depth"].alias("depth"))).alias("genotypes")).drop("key"))
    merged = merge_made(cohorts, "depth", 3)
    told = lambda df: {r["start"]: [tuple(g) for g in r["genotypes"]] for r in df.collect()}
    assert told(merged) == told(merge_variants(frames)) and len(told(merged)) == 30
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython [") < plan.index("Exchange")
    totals = merged.select("start", field_totals("genotypes", "depth").alias("t"))
    assert {r["start"]: tuple(r["t"]) for r in totals.collect()} == {k: (len(v), sum(x for _, x in v if x is not None)) for k, v in told(merged).items()}
    assert "totals_of(merge(" in totals._jdf.queryExecution().executedPlan().toString()  # in one worker


def test_pipe(spark, tmp_path):
    df = spark.createDataFrame([("hello",), ("world",), (None,)], "x string").coalesce(1)
    assert [r.text for r in pipe(df, ["cat"]).collect()] == ["hello", "world"]
    assert [r.text for r in registry.transform("pipe", df, cmd='["rev"]', input_formatter="text", output_formatter="text").collect()] == ["olleh", "dlrow"]
    assert [r.text for r in pipe(df, ["sh", "-c", "cat; echo $WHO"], env={"WHO": "me"}, in_header="head").collect()] == ["head", "hello", "world", "me"]
    assert [r.text for r in pipe(df, ["cat"], in_header="head", out_ignore_header=True).collect()] == ["hello", "world"]
    assert pipe(df.limit(0), ["cat"]).count() == 0
    with pytest.raises(Exception, match="exited with status 3"):
        pipe(df, ["sh", "-c", "exit 3"]).collect()
    with pytest.raises(Exception, match="exited with status"):
        pipe(df, ["false"], quarantine_table=str(tmp_path / "q"))
    assert spark.read.csv(str(tmp_path / "q")).count() >= 2
    with pytest.raises(ValueError):
        pipe(df.selectExpr("x", "x y"), ["cat"])


def test_pipe_quarantines_the_failed_partition(spark, tmp_path):
    df = spark.createDataFrame([(f"row {i}" if i != 17 else "bad",) for i in range(40)], "x string").repartition(4)
    parts = df.withColumn("p", F.spark_partition_id()).collect()
    bad = {r.x for r in parts if r.p == next(q.p for q in parts if q.x == "bad")}
    held = df.localLimit(100) if hasattr(df, "localLimit") else df
    with pytest.raises(Exception, match="exited with status"):
        pipe(held, ["sh", "-c", "while read -r x; do if [ \"$x\" = bad ]; then exit 5; fi; echo \"$x\"; done"], quarantine_table=str(tmp_path / "q"), quarantine_flavor="parquet")
    assert {r.x for r in spark.read.parquet(str(tmp_path / "q")).collect()} == bad and len(bad) < 40
    assert pipe(df, ["cat"], quarantine_table=str(tmp_path / "none")).count() == 40 and not (tmp_path / "none").exists()
    pipe_cleanup()


def test_pipe_holds_a_block_whatever_passes_through(tmp_path):
    import subprocess
    import sys

    script = """
import resource
from helixframe.operators.pipe import streamed
line = "x" * 999
n = sum(len(b) for b in streamed(["cat"], {}, [], (line for _ in range(1_000_000))))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=300).stdout.split()[-2:])
    assert n == 1_000_000 and mb < 300  # of a gigabyte, with all imports


def test_pipe_vcf(spark):
    df = spark.createDataFrame([("1", 9, 10, "A", ["C"], [("s", [0, 1])])], SITE + ", genotypes array<struct<sampleId:string,calls:array<int>>>")
    out = pipe(df, ["cat"], "vcf", "vcf")
    r = out.first()
    assert (r.contigName, r.start, r.end, r.alternateAlleles, r.genotypes[0].sampleId, r.genotypes[0].calls) == ("1", 9, 10, ["C"], "s", [0, 1])
    pipe_cleanup()


def test_registry(spark):
    registry.register_transformer("addOne", lambda df, to: df.withColumn(to, F.lit(1)))
    assert registry.transform("add_one", spark.range(1), {"to": "x"}).first().x == 1
    with pytest.raises(ValueError):
        registry.transform("nothing", spark.range(1))


@pytest.mark.parametrize("semi", [False, True])
def test_a_large_right_side_is_not_broadcast(spark, monkeypatch, semi):
    """Beyond a counted size right is shuffled, whatever its files weigh, with the same rows."""
    from helixframe.operators import overlap_join as o

    left = spark.range(300).select((F.col("id") * 7 % 500).alias("start"), (F.col("id") * 7 % 500 + 1 + F.col("id") % 40).alias("end"), F.col("id").alias("l"))
    right = spark.range(200).select((F.col("id") * 11 % 480).alias("start"), (F.col("id") * 11 % 480 + 1 + F.col("id") % 9).alias("end"), *([] if semi else [F.col("id").alias("r")]))
    join = (lambda: o.left_semi_overlap_join(left, right, bin_size=16)) if semi else (lambda: o.left_overlap_join(left, right, right_prefix="r_", bin_size=16))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = join()
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(o, "BROADCAST_ROWS", 100)
    large = join()
    assert "Broadcast" not in plan(large)
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_merged_totals_go_some_rows_at_a_time(spark, monkeypatch):
    """The totals of merged genotypes, of slices of a batch, so that tasks need not grow in number with the genotypes."""
    from helixframe.functions.genotypes import field_totals
    from helixframe.operators import sample_stats
    from helixframe.stats.kernels import Made

    rows = spark.range(9).selectExpr("'1' AS contigName", "id AS start", "id + 1 AS end", "'A' AS referenceAllele", "array('C') AS alternateAlleles", "id AS key")
    made = Made(lambda key: pa.array([[None if b == k % 4 else k + b for b in range(4)] for k in key.to_pylist()], pa.list_(pa.int32())), [F.col("key")], 1)
    cohorts = [(rows, list("abcd"), made), (rows.where("key > 3"), list("dcba"), made)]
    want = {r.start: tuple(r.t) for r in sample_stats.merge_made(cohorts, "depth", 2).select("start", field_totals("genotypes", "depth").alias("t")).collect()}
    monkeypatch.setattr(sample_stats, "MERGED", 16)  # two rows
    totals = sample_stats.merge_made(cohorts, "depth", 1, totals=True)
    assert {r.start: tuple(r.t) for r in totals.collect()} == want and len(want) == 9
    assert "array<struct<sampleId" not in totals._jdf.queryExecution().analyzed().toString()
