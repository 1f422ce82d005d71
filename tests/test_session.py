"""Session registration and the package without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

import helixframe as hf

ROOT = Path(__file__).resolve().parent.parent


def test_sql_functions(spark):
    hf.register(spark)
    r = spark.sql("SELECT array_quantile(array(5D, 1D, 2D, 3D, 4D), 0.7D) AS q, mean_substitute(array(1D, -1D, 3D)) AS m, mean_substitute(array(5D, 7D), 5D) AS n, comb(44L, 20L) AS c, genotype_states(array(array(0, 1), array(-1, 0), array(1, 1))) AS g").first()
    assert (round(r.q, 9), r.m, r.n, r.c, r.g) == (3.8, [1, 2, 3], [7, 7], 1761039350070, [1, -1, 2])
    with pytest.raises(Exception, match="no good"):
        spark.sql("SELECT assert_true_or_error(false, 'no good')").collect()


def test_reader(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"G\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\n")
    df = hf.reader(spark).format("com.example.vcf").option("includeSampleIds", "false").options(useTabixIndex=True).load(str(tmp_path / "a.vcf"))
    assert df.first().genotypes[0].calls == [0, 1] and df.schema["genotypes"].dataType.elementType.fieldNames() == ["phased", "calls"]
    with pytest.raises(ValueError):
        hf.reader(spark).format("hail")
    with pytest.raises(ValueError):
        hf.reader(spark).option("splitToBiallelic", True)


def test_genotype_functions_in_sql(spark):
    hf.register(spark)
    spark.createDataFrame([([([0, 1], 3, 20), ([1, 1], 5, None), ([-1, 0], None, 40)],)], "genotypes array<struct<calls:array<int>,depth:int,conditionalQuality:int>>").createOrReplaceTempView("cohort")
    r = spark.sql("SELECT call_summary_stats(genotypes) AS s, call_summary_stats(genotypes.calls) AS c, hardy_weinberg(genotypes) AS h, dp_summary_stats(genotypes) AS d, gq_summary_stats(genotypes) AS q, genotype_states(genotypes) AS g, array_summary_stats(array(1D, 3D)) AS a FROM cohort").first()
    assert r.s == r.c and (r.s.nCalled, r.s.nHet, r.s.alleleCounts) == (2, 1, [2, 3]) and r.g == [1, 2, -1]
    assert (r.d.mean, r.q.mean, r.a.mean) == (4.0, 30.0, 2.0) and 0 < r.h.pValueHwe <= 1


def test_sample_statistics_in_sql(spark):
    """Aggregates and table functions give what the DataFrame functions give."""
    from pyspark.sql import functions as F

    from helixframe.operators import sample_stats

    hf.register(spark)
    one, alts = ("s", [0, 1], 3, 20), [("A", ["C"]), ("A", ["G", "T"]), ("AC", ["A", "*"]), ("A", ["AG"])]
    rows = [(r, a, [one, ("t", [1, len(a)], i, None), ("u", [-1, 0], None, 40 + i)]) for i, (r, a) in enumerate(alts)] + [("A", ["C"], None), (None, ["C"], [one])]
    df = spark.createDataFrame(rows, "referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,calls:array<int>,depth:int,conditionalQuality:int>>").repartition(3)
    df.createOrReplaceTempView("cohort_rows")
    want = sample_stats.sample_call_summary_stats(df).first()[0]
    got = spark.sql("SELECT sample_call_summary_stats(genotypes, referenceAllele, alternateAlleles) AS s FROM cohort_rows").first().s
    assert [repr(x.asDict()) for x in got] == [repr(x.asDict()) for x in want]
    for name, f in (("dp", sample_stats.sample_dp_summary_stats), ("gq", sample_stats.sample_gq_summary_stats)):
        got, want = spark.sql(f"SELECT sample_{name}_summary_stats(genotypes) AS s FROM cohort_rows").first().s, f(df).first()[0]
        assert [(x.sampleId, repr(x.mean), x.min, x.max) for x in got] == [(x.sampleId, repr(x.mean), x.min, x.max) for x in want]
        assert all(a.stdDev == b.stdDev or abs(a.stdDev - b.stdDev) < 1e-9 or a.stdDev != a.stdDev for a, b in zip(got, want))
    counts = spark.sql("SELECT min(sampleId) AS sampleId, sum(nCalled) AS nCalled, sum(nInsertion) AS nInsertion FROM sample_call_counts(TABLE(SELECT genotypes, referenceAllele, alternateAlleles FROM cohort_rows)) GROUP BY pos ORDER BY pos").collect()
    said = sample_stats.sample_call_stats_rows(df).orderBy("pos").select("sampleId", "nCalled", "nInsertion").collect()
    assert counts == said
    each = spark.sql("SELECT referenceAllele, sample_dp_summary_stats(genotypes) AS s FROM cohort_rows GROUP BY referenceAllele").collect()
    assert {r.referenceAllele: len(r.s) for r in each} == {"A": 3, "AC": 3, None: 1}
    assert df.where(F.lit(False)).selectExpr("sample_dp_summary_stats(genotypes) AS s").collect() == []


def test_kinds_of_variants_are_those_of_the_column_function(spark):
    from helixframe import functions as fx
    from helixframe.operators.sql_aggregates import change

    alleles = ["A", "C", "G", "T", "AC", "AG", "ACG", "CAC", "*", "N", "ATT", "a", ""]
    df = spark.createDataFrame([(r, a) for r in alleles for a in alleles], "r string, a string")
    assert all(change(x.r, x.a) == x.k for x in df.select("r", "a", fx.variant_type("r", "a").alias("k")).collect())


def test_matrix_rows_in_sql(spark):
    from pyspark.ml.linalg import DenseMatrix, MatrixUDT
    from pyspark.sql.types import IntegerType, StructType

    hf.register(spark)
    spark.createDataFrame([(1, DenseMatrix(2, 2, [1.0, 2.0, 3.0, 4.0])), (2, None)], StructType().add("i", IntegerType()).add("m", MatrixUDT())).createOrReplaceTempView("matrices")
    assert [tuple(r) for r in spark.sql("SELECT i, e.row FROM matrices, LATERAL explode_matrix(m) e").collect()] == [(1, [1.0, 3.0]), (1, [2.0, 4.0])]


def test_writer(spark, tmp_path):
    df = spark.createDataFrame([("1", 4, 5, "A", ["C"], [("s", [0, 1])])], "contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,calls:array<int>>>")
    hf.writer(df).format("com.example.bigvcf").mode("overwrite").save(str(tmp_path / "one.vcf"))
    assert hf.reader(spark).format("vcf").load(str(tmp_path / "one.vcf")).first().genotypes[0].calls == [0, 1]
    hf.writer(df).format("vcf").save(str(tmp_path / "parts"))
    assert hf.reader(spark).format("vcf").load(str(tmp_path / "parts")).count() == 1
    for name in ("plink", "gff", "hail"):
        with pytest.raises(ValueError):
            hf.writer(df).format(name)


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'call_summary_stats' in q and set(s) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q), q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}).returncode == 0


def test_nothing_imports_the_training_data_operators():
    for p in (ROOT / "helixframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "helixframe.llm" not in p.read_text(), p
