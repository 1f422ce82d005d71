"""File sources and sinks, on files written here."""

import gzip
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.sources import read_bgen, read_gff, read_plink, read_vcf, write_bigbgen, write_bigvcf, write_vcf
from helixframe.sources.files import BGZF_END, bgzf_compress

HEADER = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count, of alleles">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=AF,Number=A,Type=Float,Description="Share">
##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples">
##INFO=<ID=END,Number=1,Type=Integer,Description="End">
##INFO=<ID=CSQ,Number=.,Type=String,Description="Effects. Format: Allele|Consequence|EXON|Amino_acids|SYMBOL">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="Likelihoods">
##FORMAT=<ID=FT,Number=1,Type=String,Description="Filter">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
"""
LINES = [
    "1\t10\trs1;x\tA\tC,G\t29.5\tPASS\tAC=1,2;DB;AF=0.5,.;NS=3\tGT:DP:AD\t0|1:7:1,2,3\t./2:.:.",
    "1\t20\t.\tAT\tA\t.\tq10;s50\tNS=.;AF=NaN;CSQ=A|a&b|1/2|T/M|X,A||||\tGT:GL\t1:-0.1,-INF\t0/1",
    "2\t30\t.\tG\t<DEL>\tinf\t.\tEND=99\tDP:GT:FT\t4:1/1:a;b\t.",
    "2\t40\t.\tG\t.\t1\t.\t.\tGT\t.\t0/0",
]


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    text = HEADER + "\n".join(LINES) + "\n"
    (d / "a.vcf").write_text(text)
    (d / "a.vcf.gz").write_bytes(gzip.compress(text.encode()))
    (d / "a.vcf.bgz").write_bytes(bgzf_compress(text.encode()) + BGZF_END)
    return d


def test_vcf_rows(spark, vcf):
    df = read_vcf(spark, str(vcf / "a.vcf"))
    assert "INFO_END" not in df.columns and df.schema["INFO_AC"].metadata["vcf_header_count"] == "A"
    a, b, c, d = df.orderBy("start").collect()
    assert (a.contigName, a.start, a.end, a.names, a.alternateAlleles, a.qual, a.filters) == ("1", 9, 10, ["rs1", "x"], ["C", "G"], 29.5, ["PASS"])
    assert (a.INFO_AC, a.INFO_DB, a.INFO_AF, a.INFO_NS) == ([1, 2], True, [0.5, None], 3)
    assert (a.genotypes[0].sampleId, a.genotypes[0].phased, a.genotypes[0].calls, a.genotypes[0].depth, a.genotypes[0].alleleDepths) == ("s1", True, [0, 1], 7, [1, 2, 3])
    assert (a.genotypes[1].phased, a.genotypes[1].calls, a.genotypes[1].depth, a.genotypes[1].alleleDepths) == (False, [-1, 2], None, None)
    assert b.names is None and b.filters == ["q10", "s50"] and b.INFO_NS is None and b.INFO_AF[0] != b.INFO_AF[0] and not b.INFO_DB
    e = b.INFO_CSQ
    assert e[0].Consequence == ["a", "b"] and (e[0].EXON.rank, e[0].EXON.total, e[0].Amino_acids.variant, e[0].SYMBOL) == (1, 2, "M", "X") and e[1].Consequence is None and e[1].EXON is None
    assert b.genotypes[0].calls == [1] and b.genotypes[0].genotypeLikelihoods == [-0.1, float("-inf")] and b.genotypes[1].genotypeLikelihoods is None
    assert (c.end, c.qual, c.genotypes[0].depth, c.genotypes[0].calls, c.genotypes[0].filters, c.genotypes[1].calls) == (99, float("inf"), 4, [1, 1], ["a", "b"], None)
    assert d.alternateAlleles is None and d.genotypes[0].calls == [-1]


def test_vcf_options_and_compression(spark, vcf):
    plain = {str(r) for r in read_vcf(spark, str(vcf / "a.vcf")).collect()}
    for name in ("a.vcf.gz", "a.vcf.bgz"):
        assert {str(r) for r in read_vcf(spark, str(vcf / name)).collect()} == plain
    assert read_vcf(spark, str(vcf)).count() == 12
    df = read_vcf(spark, str(vcf / "a.vcf"), include_sample_ids=False, flatten_info_fields=False)
    assert "sampleId" not in df.schema["genotypes"].dataType.elementType.fieldNames()
    assert df.where("start = 9").first().attributes == {"AC": "1,2", "DB": "", "AF": "0.5,.", "NS": "3"}


def test_stringency(spark, tmp_path):
    (tmp_path / "b.vcf").write_text(HEADER + "1\t10\t.\tA\tC\t1\t.\tNS=many\tGT\t0/1\t0/0\n")
    assert read_vcf(spark, str(tmp_path / "b.vcf")).first().INFO_NS is None
    with pytest.raises(Exception):
        read_vcf(spark, str(tmp_path / "b.vcf"), validation_stringency="strict").collect()


def test_repeated_info_keys(spark, tmp_path):
    (tmp_path / "r.vcf").write_text(HEADER + "1\t10\t.\tA\tC\t1\t.\tNS=1;DB;NS=2;DB\tGT\t0/1\t0/0\n")
    assert read_vcf(spark, str(tmp_path / "r.vcf"), flatten_info_fields=False).first().attributes == {"NS": "1", "DB": ""}
    assert read_vcf(spark, str(tmp_path / "r.vcf")).first().INFO_NS == 1


def test_many_samples(spark, tmp_path):
    import time

    names = [f"sample{i}" for i in range(100_000)]
    head = "##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "m.vcf").write_text(head + "\t".join(names) + "\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(["0/1"] * len(names)) + "\n")
    began = time.time()
    df = read_vcf(spark, str(tmp_path / "m.vcf"))
    assert time.time() - began < 5
    last = df.select(F.size("genotypes").alias("n"), F.element_at("genotypes", -1).alias("g")).first()
    assert (last.n, last.g.sampleId, last.g.calls) == (100_000, "sample99999", [0, 1])


def test_block_gzip_is_split_whatever_its_name(spark, tmp_path, monkeypatch):
    from helixframe.sources import files

    data = bgzf_compress(("\n".join(f"line {i} " + "y" * 300 for i in range(4000)) + "\n").encode()) + BGZF_END
    import gzip

    (tmp_path / "a.gz").write_bytes(data)
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"plain\n"))
    monkeypatch.setattr(files, "SPLIT", len(data) // 4)
    lines = files.text_lines(spark, [(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("a.gz", "b.gz")])
    assert lines.count() == 4001 and lines.rdd.getNumPartitions() >= 5


def test_bgzf_splits_meet(spark, tmp_path):
    from helixframe.sources.files import bgzf_lines

    lines = [f"line {i} " + "x" * (i % 900) for i in range(3000)]
    data = bgzf_compress(("\n".join(lines) + "\n").encode()) + BGZF_END
    (tmp_path / "t.bgz").write_bytes(data)
    for step in (777, 30_000, len(data)):
        got = [x.decode() for s in range(0, len(data), step) for x in bgzf_lines(str(tmp_path / "t.bgz"), s, min(len(data), s + step), len(data))]
        assert got == lines


def test_vcf_round_trips(spark, vcf, tmp_path):
    df = read_vcf(spark, str(vcf / "a.vcf"))
    want = sorted(map(str, df.select(sorted(df.columns)).collect()))
    write_vcf(df, str(tmp_path / "dir"))
    for name in ("one.vcf", "one.vcf.bgz", "one.vcf.gz"):
        write_bigvcf(df.repartition(3), str(tmp_path / name))
    for name in ("dir", "one.vcf", "one.vcf.bgz", "one.vcf.gz"):
        back = read_vcf(spark, str(tmp_path / name))
        order = [f.name for f in df.schema["genotypes"].dataType.elementType]
        back = back.withColumn("genotypes", F.transform("genotypes", lambda g: F.struct(*[g[n].alias(n) for n in order])))
        got = sorted(map(str, back.select(sorted(df.columns)).collect()))
        assert len(got) == 4
        # a missing genotype of one sample is written as a missing call
        assert [x for x in got if "'2'" not in x] == [x for x in want if "'2'" not in x], name
    with pytest.raises(FileExistsError):
        write_bigvcf(df, str(tmp_path / "one.vcf"))
    write_bigvcf(df.limit(1), str(tmp_path / "one.vcf"), mode="ignore")
    assert read_vcf(spark, str(tmp_path / "one.vcf")).count() == 4
    write_bigvcf(df.limit(1), str(tmp_path / "one.vcf"), mode="overwrite")
    assert read_vcf(spark, str(tmp_path / "one.vcf")).count() == 1
    with pytest.raises(ValueError):
        write_vcf(df.drop("start"), str(tmp_path / "no"))


def test_cohorts_with_different_samples_in_one_file(spark, tmp_path):
    kind = "contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,calls:array<int>,depth:int>>"
    rows = [("1", 4, 5, "A", ["C"], [("b", [0, 1], 3), ("a", [1, 1], None)]), ("1", 8, 9, "A", ["C"], [("c", [0, 0], 9), ("a", [0, 1], 2)]), ("1", 12, 13, "A", ["C"], None)]
    df = spark.createDataFrame(rows, kind).repartition(2, "start")
    write_bigvcf(df, str(tmp_path / "one.vcf"))
    write_vcf(df, str(tmp_path / "many"))
    for name in ("one.vcf", "many"):
        one, two, three = read_vcf(spark, str(tmp_path / name)).orderBy("start").collect()
        assert [g.sampleId for g in one.genotypes] == ["a", "b", "c"]
        assert [(g.calls, g.depth) for g in one.genotypes] == [([1, 1], None), ([0, 1], 3), ([-1], None)]
        assert [(g.calls, g.depth) for g in two.genotypes] == [([0, 1], 2), ([-1], None), ([0, 0], 9)]
        assert three.genotypes is None
    mixed = spark.createDataFrame([("1", 4, 5, "A", ["C"], [("b", [0, 1], 3), (None, [1, 1], 1)])], kind)
    with pytest.raises(ValueError, match="none"):
        write_bigvcf(mixed, str(tmp_path / "no.vcf"))
    with pytest.raises(ValueError, match="numbers"):
        write_bigvcf(df.withColumn("genotypes", F.slice("genotypes", 1, (F.col("start") / 4).cast("int"))).withColumn("genotypes", F.transform("genotypes", lambda g: g.dropFields("sampleId"))), str(tmp_path / "no.vcf"))


def test_plink(spark, tmp_path, monkeypatch):
    calls = {0: [1, 1], 1: [-1, -1], 2: [0, 1], 3: [0, 0]}
    codes = [[(v + s) % 4 for s in range(5)] for v in range(7)]
    body = b"".join(bytes([sum(c << (2 * i) for i, c in enumerate(row[:4])), row[4]]) for row in codes)
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "x.bim").write_text("".join(f"{v}\trs{v}\t0.{v}\t{v + 1}\tA\tCC\n" for v in range(7)))
    (tmp_path / "x.fam").write_text("".join(f"f s{i} 0 0 0 0\n" for i in range(5)))
    rows = read_plink(spark, str(tmp_path / "x.bed")).orderBy("start").collect()
    assert [[g.calls for g in r.genotypes] for r in rows] == [[calls[c] for c in row] for row in codes]
    assert (rows[1].contigName, rows[1].start, rows[1].end, rows[1].referenceAllele, rows[1].alternateAlleles, rows[1].names, rows[1].genotypes[0].sampleId) == ("1", 1, 3, "CC", ["A"], ["rs1"], "f_s0")
    assert read_plink(spark, str(tmp_path / "x.bed"), merge_fid_iid=False).first().genotypes[0].sampleId == "s0"
    for split in (1, 9, 20):  # stretches of .bim of every length, its last line without an end
        monkeypatch.setattr("helixframe.sources.plink.SPLIT", split)
        assert [[g.calls for g in r.genotypes] for r in read_plink(spark, str(tmp_path / "x.bed")).orderBy("start").collect()] == [[calls[c] for c in row] for row in codes]
        (tmp_path / "x.bim").write_text((tmp_path / "x.bim").read_text().rstrip("\n"))
    (tmp_path / "x.bim").write_text("1\trs\t0\t1\tA\tCC\n")
    with pytest.raises(Exception, match="holds 7 variants, but its .bim file has 1 lines"):
        read_plink(spark, str(tmp_path / "x.bed")).collect()
    (tmp_path / "y.bed").write_bytes(b"abc")
    with pytest.raises(ValueError, match="Magic"):
        read_plink(spark, str(tmp_path / "y.bed"))


def test_undeclared_format_keys_round_trip(spark, tmp_path):
    head = '##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description="G">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt\n'
    (tmp_path / "a.vcf").write_text(head + "1\t5\t.\tA\tC\t.\t.\t.\tGT:XX:AB:XX\t0/1:7:1,2:9\t1/1:.\n1\t9\t.\tA\tC\t.\t.\t.\tGT\t0/1\t./.\n")
    df = read_vcf(spark, str(tmp_path / "a.vcf"), include_other_fields=True)
    one, two = df.orderBy("start").collect()
    assert [g.otherFields for g in one.genotypes] == [{"XX": "7", "AB": "1,2"}, {"XX": "."}] and [g.otherFields for g in two.genotypes] == [{}, {}]
    assert "otherFields" not in read_vcf(spark, str(tmp_path / "a.vcf")).schema["genotypes"].dataType.elementType.fieldNames()
    write_bigvcf(df.coalesce(1), str(tmp_path / "b.vcf"))
    lines = [x.split("\t")[8:] for x in (tmp_path / "b.vcf").read_text().splitlines() if not x.startswith("#")]
    assert lines == [["GT:AB:XX", "0/1:1,2:7", "1/1:.:."], ["GT", "0/1", "./."]]


BGEN = "contigName string, start long, end long, names array<string>, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,phased:boolean,ploidy:int,posteriorProbabilities:array<double>>>"


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_bgen_round_trip(spark, tmp_path, bits):
    rows = [("1", i, i + 1, [f"v{i}", f"rs{i}"], "A", ["C"], [("a", False, 2, [1.0, 0.0, 0.0]), ("b", False, 2, []), ("c", False, 2, [0.2, 0.3, 0.5])]) for i in range(20)]
    rows += [("2", 5, 7, ["p", "q"], "AT", ["C", "G"], [("a", True, 2, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), ("b", True, 1, [1.0, 0.0, 0.0]), ("c", True, 2, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])])]
    df = spark.createDataFrame(rows, BGEN)
    path = str(tmp_path / "x.bgen")
    write_bigbgen(df.repartition(3, "start"), path, bits_per_probability=bits)
    back = {r.names[0]: r for r in read_bgen(spark, path).collect()}
    assert len(back) == 21
    r = back["v3"]
    assert (r.start, r.end, r.alternateAlleles, r.genotypes[0].calls, r.genotypes[1].calls, r.genotypes[1].posteriorProbabilities) == (3, 4, ["C"], [0, 0], [-1, -1], [])
    assert r.genotypes[2].posteriorProbabilities == pytest.approx([0.2, 0.3, 0.5], abs=2.0 / 2**bits) and r.genotypes[2].sampleId == "c"
    p = back["p"]
    assert p.genotypes[0].phased and p.genotypes[0].calls == [1, 2] and p.genotypes[1].ploidy == 1 and p.genotypes[1].posteriorProbabilities == [1.0, 0.0, 0.0]
    assert "calls" not in read_bgen(spark, path, emit_hard_calls=False).schema["genotypes"].dataType.elementType.fieldNames()
    (tmp_path / "s.sample").write_text("ID_1 ID_2 missing\n0 0 0\n1 x 0\n2 y 0\n3 z 0\n")
    assert [g.sampleId for g in read_bgen(spark, path, sample_file=str(tmp_path / "s.sample")).first().genotypes] == ["x", "y", "z"]


def test_bgen_files_by_tasks(spark, tmp_path, monkeypatch):
    from helixframe.sources import bgen, write_bgen

    rows = [("1", i, i + 1, [f"v{i}", "r"], "A", ["C"], [("a", False, 2, [1.0, 0.0, 0.0]), ("b", False, 2, [])]) for i in range(40)]
    df = spark.createDataFrame(rows, BGEN)
    made = write_bgen(df.repartition(3, "start"), str(tmp_path / "out")).collect()
    assert sum(r.variants for r in made) == 40 and sorted(r.file for r in made) == sorted(p.name for p in (tmp_path / "out").iterdir())
    back = read_bgen(spark, str(tmp_path / "out"))
    assert sorted(r.start for r in back.collect()) == list(range(40)) and back.first().genotypes[1].sampleId == "b"
    monkeypatch.setattr(bgen, "FILE_BYTES", 1)
    assert write_bgen(df.coalesce(1), str(tmp_path / "out"), mode="overwrite").count() == 40 and read_bgen(spark, str(tmp_path / "out")).count() == 40
    with pytest.raises(ValueError, match="samples"):
        write_bgen(df.withColumn("genotypes", F.slice("genotypes", 1, (F.col("start") % 2 + 1).cast("int"))), str(tmp_path / "no"))


def test_bgen_probabilities_sum_to_whole(spark):
    import numpy as np

    from helixframe.sources.bgen import whole_numbers

    r = np.random.default_rng(1)
    for bits in (8, 16):
        for _ in range(50):
            p = r.dirichlet(np.ones(4))
            assert abs(int(whole_numbers(p, bits).sum()) - (2**bits - 1)) <= 1


def test_bgen_index(spark, tmp_path):
    import sqlite3

    from helixframe.sources.bgen import chunks

    rows = [("1", i, i + 1, ["v", "r"], "A", ["C"], [("a", False, 2, [1.0, 0.0, 0.0])]) for i in range(5)]
    path = str(tmp_path / "i.bgen")
    write_bigbgen(spark.createDataFrame(rows, BGEN).coalesce(1), path)
    plain = list(chunks(path, True))
    assert [n for _, n in plain] == [5]
    with sqlite3.connect(path + ".bgi") as db:
        db.execute("CREATE TABLE Variant (file_start_position INTEGER)")
        db.execute("INSERT INTO Variant VALUES (?)", (plain[0][0],))
    assert list(chunks(path, True)) == [(plain[0][0], 1)] and struct.calcsize("<I") == 4


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text(
        "##gff-version 3\n"
        "chr1\tsrc\tgene\t10\t20\t.\t+\t.\tID=g1;Dbxref=a:1,b:2;gene_Name=G one;Is_circular=true\n"
        "chr1\tsrc\tCDS\t12\t18\t3.5\t-\t0\tID=c1;Parent=g1,g2;Note=x\n"
        "##FASTA\n>chr1\nACGT\n"
    )
    df = read_gff(spark, str(tmp_path / "a.gff"))
    assert df.columns == ["seqId", "source", "type", "start", "end", "score", "strand", "phase", "id", "parent", "note", "dbxref", "iscircular", "gene_Name"]
    a, b = df.orderBy("start").collect()
    assert (a.start, a.end, a.score, a.phase, a.id, a.dbxref, a.iscircular, a.gene_Name) == (9, 20, None, None, "g1", ["a:1", "b:2"], True, "G one")
    assert (b.parent, b.note, b.score, b.strand) == (["g1", "g2"], ["x"], 3.5, "-")
    from pyspark.sql.types import StringType, StructType

    own = read_gff(spark, str(tmp_path / "a.gff"), StructType().add("attributes", StringType()).add("ID", StringType()))
    assert own.columns == ["attributes", "ID"] and own.where("ID = 'g1'").first().attributes.startswith("ID=g1")


def test_bgen_genotypes_are_encoded_and_decoded_as_arrays(spark, tmp_path):
    """Even samples take the quick ways, and these give what a sample at a time gives; genotypes and blocks stay in the worker."""
    from helixframe.functions.genotypes import call_totals
    from helixframe.sources import bgen, read_bgen_blocks, write_bgen
    from helixframe.stats.kernels import Made

    rng = np.random.default_rng(0)
    for k, bits in ((2, 8), (3, 16), (4, 32)):
        p = [rng.dirichlet(np.ones(k * (k + 1) // 2)).tolist() if i % 4 else [] for i in range(40)] + [[1.0] + [0.0] * (k * (k + 1) // 2 - 1)]
        rows = [{"phased": False, "ploidy": 2, "posteriorProbabilities": x} for x in p]
        quick = bgen.diploid_encoded(pa.array(rows, pa.struct([("phased", pa.bool_()), ("ploidy", pa.int32()), ("posteriorProbabilities", pa.list_(pa.float64()))])), k, bits, 2, False)
        assert quick == bgen.encoded_genotypes(rows, k, bits, 10, 2, False)
        block = bgen.plain_block(quick[4:], 1)
        phased, ploidy, probs = bgen.probabilities(block)
        assert bgen.calls_of_block(block, 0.4).tolist() == [bgen.hard_call(x, n, phased, k, 0.4) for x, n in zip(probs, ploidy)]
    df = spark.createDataFrame([("1", i, "A", ["C"]) for i in range(9)], "contigName string, start long, referenceAllele string, alternateAlleles array<string>")

    def made(start):
        rows = [[{"phased": False, "ploidy": 2, "posteriorProbabilities": [float(j == (s + i) % 3) for j in range(3)]} for i in range(4)] for s in start.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("phased", pa.bool_()), ("ploidy", pa.int32()), ("posteriorProbabilities", pa.list_(pa.float64()))])))

    write_bgen(df.repartition(2, "start"), str(tmp_path / "m"), genotypes=Made(made, [F.col("start")], 2), sample_ids=list("abcd"))
    back = read_bgen_blocks(spark, str(tmp_path / "m")).select("start", call_totals(bgen.made_calls()).alias("t"))
    assert "ArrowEvalPython [totals_of(" in back._jdf.queryExecution().executedPlan().toString()
    assert {r.start: tuple(r.t) for r in back.collect()} == {s: (4, sum((s + i) % 3 for i in range(4)), sum((s + i) % 3 == 2 for i in range(4))) for s in range(9)}
    assert [g.sampleId for g in read_bgen(spark, str(tmp_path / "m")).first().genotypes] == list("abcd")


def test_bgen_stretches_are_read_by_tasks_of_their_own(spark, tmp_path, monkeypatch):
    from helixframe.sources import bgen, write_bgen

    monkeypatch.setattr(bgen, "FILE_BYTES", 1)
    rows = spark.range(12).selectExpr("'1' AS contigName", "id AS start", "'A' AS referenceAllele", "array('C') AS alternateAlleles", "array(named_struct('ploidy', 2, 'phased', false, 'posteriorProbabilities', array(1D, 0D, 0D))) AS genotypes")
    write_bgen(rows.coalesce(1), str(tmp_path / "s"))
    found = bgen.stretches(spark, bgen.bgen_files(spark, str(tmp_path / "s"), False), False)
    assert found.count() == 12 and found.rdd.getNumPartitions() == 12


def test_vcf_genotypes_are_written_and_parsed_as_arrays(spark, tmp_path):
    """Even rows take the quick ways, uneven ones go a sample at a time, and both give what write_vcf and read_vcf give; genotypes stay in the worker."""
    from helixframe.functions.genotypes import first_call_totals
    from helixframe.sources import read_vcf_lines, vcf_cells
    from helixframe.stats.kernels import Made

    kind = "array<struct<calls: array<int>, depth: int, conditionalQuality: int>>"
    arrow = pa.list_(pa.struct([("calls", pa.list_(pa.int32())), ("depth", pa.int32()), ("conditionalQuality", pa.int32())]))
    rng = np.random.default_rng(1)
    even = [[{"calls": rng.integers(-1, 3, 2).tolist(), "depth": None if r == 1 or rng.random() < 0.3 else int(rng.integers(-20, 3000)), "conditionalQuality": int(rng.integers(0, 99))} for _ in range(5)] for r in range(4)]
    odd = [[{"calls": [[0], [1, -1, 0], [], None, [0, 12]][i], "depth": i, "conditionalQuality": None} for i in range(5)]]
    assert vcf_cells.even_cells(pa.array(odd, arrow)) is None
    for rows, width in ((even, 4), (even + odd, 2)):
        df = spark.createDataFrame([("1", i, i + 1, "A", ["C", "G"], i, g) for i, g in enumerate(rows)], f"contigName string, start long, end long, referenceAllele string, alternateAlleles array<string>, i int, genotypes {kind}").coalesce(1)
        name = str(tmp_path / f"v{width}")
        write_vcf(df.drop("i"), name + "plain", sample_ids=list("abcde"))
        write_vcf(df.drop("genotypes"), name, sample_ids=list("abcde"), genotypes=Made(lambda i, rows=rows: pa.array([rows[k] for k in i.to_pylist()], arrow), [F.col("i")], width, kind))
        assert sorted(r.value for r in spark.read.text(name).collect()) == sorted(r.value for r in spark.read.text(name + "plain").collect())
        back, genotypes = read_vcf_lines(spark, name, ["calls", "depth"])
        got = {r.start: tuple(r.t) for r in back.select("start", first_call_totals(genotypes, "depth").alias("t")).collect()}
        plain = {r.start: r.genotypes for r in read_vcf(spark, name).collect()}
        assert got == {s: (5, sum(x.calls[0] for x in g if x.calls), sum(x.depth or 0 for x in g)) for s, g in plain.items()}
    lines = ["1\t1\t.\tA\tC\t.\t.\t.\tDP:GT\t7:0/1\t.:./1\t12:1|0", "1\t1\t.\tA\tC\t.\t.\t.\tGT:XX:DP\t0/1\t1:a\t1/1:b:+3", "1\t1\t.\tA\tC"]
    first = [{"calls": [0, 1], "depth": 7}, {"calls": [-1, 1], "depth": None}, {"calls": [1, 0], "depth": 12}]
    second = [{"calls": [0, 1], "depth": None}, {"calls": [1], "depth": None}, {"calls": [1, 1], "depth": 3}]
    ids = {"calls": "GT", "depth": "DP"}
    assert vcf_cells.genotypes_of(pa.array(lines[:1]), 3, ids).to_pylist() == [first] and vcf_cells.genotypes_of(pa.array(lines), 3, ids).to_pylist() == [first, second, None]
