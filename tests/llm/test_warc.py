import base64
import hashlib

from helixframe.llm.warc import read_archives, write_archives

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    pages = [(i, f"http://example.com/{i}?q=ä b", f"<p>{i % 20} ü</p>" * (1 + i % 20)) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (None, "n", "<p>5 ü</p>" * 6), (3, "again", "<p>3 ü</p>" * 4)]
    folder, index = write_archives(spark.createDataFrame(pages, SCHEMA), file_bytes=2000)
    rows = read_archives(spark, folder, index, chunk_bytes=700, gap_bytes=10).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in pages:
        data = (h or "").encode()
        found = [r for r in rows if r.page_id == i and r.payload_bytes == len(data)]
        assert found
        for r in found:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            lead = first[h or ""]
            assert (r.record_type, r.refers_to) == (("response", None) if i == lead else ("revisit", lead))
            assert (r.payload == data) if r.record_type == "response" else r.payload is None


def test_selected_records_only(spark):
    folder, index = write_archives(spark.createDataFrame([(i, f"http://x/{i}", "abc" * i) for i in range(40)], SCHEMA))
    assert [f.name for f in index.schema][:3] == ["file", "offset", "length"]
    some = index.where("url IN ('http://x/3', 'http://x/17', 'http://x/39')")
    assert sorted(r.page_id for r in read_archives(spark, folder, some).collect()) == [3, 17, 39]


def test_least_bytes_and_empty(spark):
    folder, index = write_archives(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xyz"), (4, "d", "xyz")], SCHEMA), least_bytes=2)
    got = {r.page_id: r.record_type for r in read_archives(spark, folder, index).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder, index = write_archives(spark.createDataFrame([], SCHEMA + ", shard int, digest string"))
    assert read_archives(spark, folder, index).count() == 0


def test_long_payloads_ties_and_clashing_columns(spark):
    long = "<p>ü " * 400_000
    pages = [(1, "a", long, "x", 1), (2, "b", long, "y", 2), (1, "c", long, None, None), (3, None, "short", "z", 3)]
    df = spark.createDataFrame(pages, SCHEMA + ", digest string, refers_to int")
    folder, index = write_archives(df)
    rows = read_archives(spark, folder, index).collect()
    size = len(long.encode())
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows) == [(1, "response", None, size)] * 2 + [(2, "revisit", 1, size), (3, "response", None, 5)]


def test_reading_back_is_dealt_by_bytes(spark):
    folder, index = write_archives(spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * 2000) for i in range(200)], SCHEMA), file_bytes=20_000)
    total = index.selectExpr("sum(length)").first()[0]
    from helixframe.llm.common import dealt_by_bytes
    from pyspark.sql import functions as F

    assert dealt_by_bytes(index, F.floor(F.col("offset") / 4000), read_bytes=total // 20).rdd.getNumPartitions() >= 20
    assert dealt_by_bytes(index, F.floor(F.col("offset") / 4000)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
