"""Tabix indexes, regions, and the vcf format by name."""

import random

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

import helixframe as hf
from helixframe.sources import read_vcf, write_tabix_index
from helixframe.sources import tabix as X
from helixframe.sources.datasource import VcfReader, interval_of
from helixframe.sources.files import BGZF_END, bgzf_compress, listed

HEAD = """##fileformat=VCFv4.2
##INFO=<ID=END,Number=1,Type=Integer,Description="End">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=CSQ,Number=.,Type=String,Description="Effects. Format: Allele|Consequence|EXON|SYMBOL">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="Likelihoods">
##FORMAT=<ID=FT,Number=1,Type=String,Description="Filter">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
"""


def line(contig, start, length=None, i=0):
    info = [f"AC={i % 5}", *(["DB"] if i % 3 else []), *([f"END={start + length}"] if length else []), *(["CSQ=A|a&b|1/2|X"] if i % 7 == 0 else [])]
    return f"{contig}\t{start + 1}\tid{i};b\tAC\tA,<X>\t{i % 90 / 4}\tPASS\t{';'.join(info)}\tGT:DP:GL:FT\t0|1:{i % 40}:-0.5,NaN,-inf:a;b\t./.:.:."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for contig, reach in (("1", 200_000_000), ("2", 3_000_000), ("X", 90_000)):
        starts = sorted(r.randrange(reach) for _ in range(6000))
        out += [(contig, s, int(10 ** r.uniform(0.4, 6.5)) if r.random() < 0.03 else None) for s in starts]
    return out


@pytest.fixture(scope="module")
def files(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("tabix")
    text = HEAD + "".join(line(*x, i) + "\n" for i, x in enumerate(rows))
    for name in ("indexed.vcf.bgz", "bare.vcf.bgz"):
        (d / name).write_bytes(bgzf_compress(text.encode()) + BGZF_END)
    (d / "plain.vcf").write_text(text)
    made = write_tabix_index(spark, str(d / "indexed.vcf.bgz")).collect()
    assert [m.contigs for m in made] == [3]
    hf.register(spark)
    return d


def hits(rows, contig, start, end):
    return sorted(s for c, s, n in rows if c == contig and s < end and s + (n or 2) > start)


REGIONS = [("1", 0, 1 << 29), ("1", 50_000_000, 51_000_000), ("2", 1000, 1001), ("X", 89_000, 95_000), ("X", 16_383, 16_385), ("2", 2_999_000, 9_000_000), ("9", 0, 100), ("1", 70, 70)]


@pytest.mark.parametrize("region", REGIONS)
def test_regions(spark, files, rows, region):
    for name in ("indexed.vcf.bgz", "bare.vcf.bgz", "plain.vcf"):
        got = read_vcf(spark, str(files / name), region=region).select("start").collect()
        assert sorted(r.start for r in got) == (hits(rows, *region) if region[1] < region[2] else []), name


def test_an_index_survives_its_file_form(files):
    path = str(files / "indexed.vcf.bgz")
    made = X.indexed(path)
    assert X.unpacked(X.packed(made)) == made == X.index_of(path)
    with open(path, "rb") as f:
        size = len(f.read())
    found = X.stretches(made, X.Interval("1", 100_000_000, 101_000_000))
    assert sum((b >> 16) - (a >> 16) + 65536 for a, b in found) < 0.25 * size + 2 * X.GAP


def test_one_percent_of_a_file_is_few_bytes(spark, tmp_path):
    path = tmp_path / "big.vcf.bgz"
    r = random.Random(1)
    body = "".join(f"1\t{1 + 100 * i}\t.\tA\tC\t.\t.\tAC={r.getrandbits(300)}\tGT\t0/1\t0/0\n" for i in range(60_000))
    path.write_bytes(bgzf_compress((HEAD + body).encode()) + BGZF_END)
    write_tabix_index(spark, str(path))
    reader = VcfReader(str(path), None, {})
    reader.pushFilters([D.EqualTo(("contigName",), "1"), D.GreaterThanOrEqual(("start",), 3_000_000), D.LessThan(("start",), 3_060_000)])
    parts = reader.partitions()
    size = listed(spark, str(path))[0][1]
    assert {p.kind for p in parts} == {"stretch"} and sum((p.end >> 16) - (p.start >> 16) + (1 << 16) for p in parts) < 0.05 * size
    assert sum(1 for p in parts for _ in reader.lines(p)) < 3000
    hf.register(spark)
    assert spark.read.format("vcf").load(str(path)).where("contigName = '1' and start >= 3000000 and start < 3060000").count() == 600


def test_files_that_are_not_sorted_or_older_than_their_data(spark, tmp_path):
    import os
    import time

    (tmp_path / "a.vcf.bgz").write_bytes(bgzf_compress((HEAD + line("1", 50) + "\n" + line("1", 10) + "\n").encode()) + BGZF_END)
    with pytest.raises(Exception, match="not sorted"):
        write_tabix_index(spark, str(tmp_path / "a.vcf.bgz"))
    (tmp_path / "b.vcf.bgz").write_bytes(bgzf_compress((HEAD + line("1", 50) + "\n").encode()) + BGZF_END)
    write_tabix_index(spark, str(tmp_path / "b.vcf.bgz"))
    assert X.index_of(str(tmp_path / "b.vcf.bgz")) is not None
    os.utime(tmp_path / "b.vcf.bgz", (time.time() + 60, time.time() + 60))
    assert X.index_of(str(tmp_path / "b.vcf.bgz")) is None


def test_filters_become_an_interval():
    contig, start, end = ("contigName",), ("start",), ("end",)
    case = lambda *f: (x := interval_of(list(f))) and (x.contig, x.start, x.end)
    assert case() == (None, 0, X.LIMIT)
    assert case(D.EqualTo(contig, "1"), D.GreaterThan(start, 9), D.LessThanOrEqual(start, 20)) == ("1", 10, 21)
    assert case(D.EqualTo(start, 5)) == (None, 5, 6) and case(D.EqualTo(end, 5)) == (None, 4, 5)
    assert case(D.GreaterThanOrEqual(start, 10), D.LessThan(end, 30)) == (None, 10, 29)
    assert case(D.GreaterThan(end, 100), D.LessThan(start, 50)) == (None, 0, 50)  # such rows reach from before 50 to over 100
    assert case(D.EqualTo(contig, "1"), D.EqualTo(contig, "2")) is None
    assert case(D.GreaterThan(start, 9), D.LessThan(end, 9)) is None
    assert case(D.EqualTo(("qual",), 3), D.Not(D.EqualTo(start, 4))) == (None, 0, X.LIMIT)


CONDITIONS = ["contigName = 'X'", "contigName = '1' and start > 40000000 and end <= 60000000", "contigName = '2' and (start < 1000 or end > 2900000)", "start = 12 and contigName = '9'", "contigName = '2' and end > 500000 and start < 400000", "contigName = '1' and contigName = '2'", "qual > 20 and start >= 1000"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_the_format_gives_the_rows_of_the_reader(spark, files, condition):
    want = read_vcf(spark, str(files / "plain.vcf")).where(condition)
    key = lambda df: df.select(F.xxhash64(*df.columns).alias("h")).groupBy("h").count().orderBy("h").collect()
    for name in ("indexed.vcf.bgz", "bare.vcf.bgz"):
        got = spark.read.format("vcf").load(str(files / name))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert key(got.where(condition)) == key(want)
    off = spark.read.format("vcf").option("useTabixIndex", False).option("useFilterParser", False).load(str(files / "indexed.vcf.bgz"))
    assert off.where(condition).count() == want.count()


def test_options_of_the_format(spark, files):
    df = spark.read.format("vcf").option("flattenInfoFields", False).option("includeSampleIds", False).load(str(files / "indexed.vcf.bgz"))
    assert df.where("start = 12").columns[-2:] == ["attributes", "genotypes"] and "sampleId" not in df.schema["genotypes"].dataType.elementType.fieldNames()
    assert df.first().attributes["AC"] == "0"


@pytest.mark.parametrize("compression", ["none", "bgzf"])
def test_the_format_writes(spark, files, tmp_path, compression):
    df = spark.read.format("vcf").load(str(files / "indexed.vcf.bgz")).where("contigName = 'X' and start < 20000")
    path = str(tmp_path / "out")
    df.repartition(3).write.format("vcf").option("compression", compression).mode("append").save(path)
    back = read_vcf(spark, path)
    same = lambda x: sorted(str(r) for r in x.select("contigName", "start", "end", "INFO_AC", "INFO_DB", "INFO_CSQ", "qual", "names", "filters", F.transform("genotypes", lambda g: F.struct(g["calls"], g["phased"], g["depth"], g["filters"], g["genotypeLikelihoods"]))).collect())
    assert same(back) == same(df)
    df.limit(5).coalesce(1).write.format("vcf").mode("overwrite").save(path)
    assert read_vcf(spark, path).count() == 5


def test_a_failed_write_leaves_nothing(spark, files, tmp_path):
    df = spark.read.format("vcf").load(str(files / "indexed.vcf.bgz")).where("contigName = 'X' and start < 9000").repartition(4)
    bad = df.withColumn("contigName", F.when(F.col("start") % 7 == 3, F.raise_error(F.lit("no"))).otherwise(F.col("contigName")))
    with pytest.raises(Exception):
        bad.write.format("vcf").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("**/*.vcf")) if (tmp_path / "out").exists() else True
