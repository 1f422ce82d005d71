"""Operator 9, WARC archives written with an index first and read through it.

Each page becomes one record, compressed as a gzip member of its own. The page with the smallest
page_id among those of equal payloads is written as response, the others as revisits that refer to
it. The index, a table of file, offset, length, URL and digest per record, is what readers start
from: they select index rows, sort them, and read neighbouring records in one byte range.

Defined results: a null html is an empty payload; a null url has no target line; a null page_id is
never the smallest unless all of its group are null, and then each is a response; rows that repeat
the smallest page_id, and so tie, are responses each. Very long payloads are one record each, read back
as one byte range. Extra columns are ignored, whatever their names, and an empty table gives no archive.
Payloads under least_bytes are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import dealt_by_bytes, shared_folder, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A new archive file is begun beyond so many bytes.
FILE_BYTES = 256 << 20
#: Index rows of so many bytes of one file are read by one row of work; wider gaps are skipped.
CHUNK_BYTES, GAP_BYTES = 4 << 20, 64 << 10


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def member(page_id: int | None, url: str | None, digest: str, payload: bytes | None, n_bytes: int, refers_to: int | None, date: str, level: int) -> bytes:
    """One gzip member with a record: a response if there is a payload, else a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"") if payload is not None else http
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~-._' + chr(39))}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, wbits=31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an uncompressed record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda raw: {k.lower(): v for k, _, v in (x.partition(": ") for x in raw.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Writes pages (page_id, url, html) as archives; returns the folder and the index table.

    Payloads are compressed before the shuffle, by their digest, that meets them with the smallest
    page_id of their group. Only groups of two or more are in that table, and it is joined, not
    collected; a hot digest is split by Spark's handling of skewed joins.
    """
    folder = folder or shared_folder(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, packed, digests = [], [], []
            for i, u, h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                payload = h.as_py().encode("utf-8")
                digests.append(base64.b32encode(bytes.fromhex(d)).decode())
                sizes.append(len(payload))
                packed.append(member(i, u, digests[-1], payload, len(payload), None, date, level))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["page_id", "url", "digest", "payload_digest", "payload_bytes", "packed"],
            )

    packed = rows.mapInArrow(pack, "page_id long, url string, digest string, payload_digest string, payload_bytes long, packed binary")
    large = rows.where(F.octet_length("html") >= least_bytes) if least_bytes else rows
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    met = packed.join(firsts, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    met = met.select("page_id", "url", "payload_digest", "payload_bytes", "packed", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"archive/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(f"{root}/archive", recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = r["packed"]
                if r["refers_to"] is not None:
                    data = member(r["page_id"], r["url"], r["payload_digest"], None, r["payload_bytes"], r["refers_to"], date, level)
                out.write(data)
                rows.append((name, offset, len(data), r["url"], r["payload_digest"], "response" if r["refers_to"] is None else "revisit"))
                offset += len(data)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["file", "offset", "length", "url", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    index = met.mapInArrow(write, "file string, offset long, length long, url string, payload_digest string, record_type string")
    return folder, written(index, folder, "index")


def read_archives(spark: SparkSession, folder: str, index: DataFrame, chunk_bytes: int = CHUNK_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Selected rows of one stretch of a file are sorted and read in as few byte ranges as gaps allow.
    A response's digest is computed from what was read; it must be the one that its header states.
    """

    def ranges(entries: list[dict]) -> Iterator[list[dict]]:
        held = [entries[0]]
        for e in entries[1:]:
            if e["offset"] - (held[-1]["offset"] + held[-1]["length"]) > gap_bytes:
                yield held
                held = []
            held.append(e)
        yield held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out: list[list] = [[], [], [], [], [], [], []]
                with files.open_input_file(f"{root}/{row['file']}") as f:
                    for held in ranges(row["entries"]):
                        first = held[0]["offset"]
                        data = f.read_at(held[-1]["offset"] + held[-1]["length"] - first, first)
                        for e in held:
                            at = e["offset"] - first
                            warc, http, payload = parse(zlib.decompress(data[at : at + e["length"]], wbits=31))
                            digest = warc["warc-payload-digest"].removeprefix("sha1:")
                            revisit = warc["warc-type"] == "revisit"
                            if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{row['file']} at {e['offset']}: the payload is not the one of its digest")
                            page, refers = warc.get("page-id"), warc.get("refers-to-page-id")
                            values = (page and int(page), warc.get("warc-target-uri"), int(http["content-length"]) if revisit else len(payload), digest, warc["warc-type"], refers and int(refers), None if revisit else payload)
                            for column, value in zip(out, values):
                                column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    entry = F.struct("offset", "length")
    chunks = dealt_by_bytes(index, F.floor(F.col("offset") / chunk_bytes)).groupBy("file", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return chunks.select("file", "entries").mapInArrow(read, schema)
