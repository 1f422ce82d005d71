"""Operator 2, token ids as length-delimited binary records with an offset index.

A record file is a row of frames: length (unsigned 64 bit), masked checksum of the length (32 bit),
payload, masked checksum of the payload (32 bit), all little-endian. A payload is the document's id
(signed 64 bit) and its token ids, as 16-bit numbers while the vocabulary allows it, else as 32-bit
ones. The checksum is CRC-32, rotated right by 15 bits and offset by a constant, so that a checksum
of data that hold checksums stays sound. Files follow the ascending order of doc_id; the index is a
table of its own, with file, offset, length and the count of tokens before each document.

Defined results: null text is an empty text (its ids are the end id alone); null doc_ids come first
and read back as null; rows that share a doc_id follow each other by a hash of their texts; an empty
table gives no files. Texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import dealt_by_bytes, partitions, shared_folder, written

#: Added to the rotated checksum, as the well-known record format does.
MASK_DELTA = 0xA282EAD8
#: Null doc_ids are kept as the smallest 64-bit number.
NULL_ID = -(2**63)
#: Index entries of so many bytes of one file are read together.
CHUNK_BYTES = 8 << 20
#: Words that a worker remembers with their ids, and the characters of the longest one: about 200 MB at most.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 32
_encoders: dict[str, "WordEncoder"] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> bytes:
    """The payload of the frame at that place; raises if a checksum does not match."""
    head = data[at : at + 8]
    (n,) = struct.unpack("<Q", head)
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"a record at offset {at} is damaged")
    return payload


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, remembering the ids of words.

    Such a tokenizer splits a text before merging, and no piece reaches over a white space that
    stands alone between other characters: a space opens the next piece, a line end closes one. A
    text without two white spaces in a row is so the sequence of its words' encodings. Any other
    text, or one that holds a special token's string, is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.held: dict[str, bytes] = {}
        self.runs = re.compile(r"\s\s")

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if "\0" in text or self.runs.search(text) or any(s in text for s in self.special):
            return self.whole([text])[0]
        words = text.replace(" ", "\0 ").replace("\n", "\n\0").split("\0")
        try:
            return b"".join(map(self.held.__getitem__, words))
        except KeyError:
            if len(self.held) > CACHE_WORDS:
                self.held.clear()
            new = list({w for w in words if w not in self.held})
            ids = dict(zip(new, self.whole(new)))
            self.held.update((w, x) for w, x in ids.items() if len(w) <= CACHE_CHARS)
            return b"".join([ids[w] if w in ids else self.held[w] for w in words])


def write_records(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> tuple[str, DataFrame]:
    """Writes df's encoded texts as record files and the index; returns the folder and the index table.

    Texts are dealt by ranges of doc_id, so each task writes one file of a contiguous range.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.records"  # a repeated attempt writes a file of its own
        out, offset, start = None, 0, 0
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    files.create_dir(f"{root}/records", recursive=True)
                    out = files.open_output_stream(f"{root}/records/{name}")
                ids = encoder.encode(text.as_py()) + end
                data = frame(struct.pack("<q", NULL_ID if i is None else i) + ids)
                out.write(data)
                n = len(ids) // encoder.dtype.itemsize
                rows.append((part, f"records/{name}", offset, len(data), start, n, encoder.dtype.itemsize))
                offset, start = offset + len(data), start + n
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ("part", "file", "offset", "length", "local_start", "n_tokens", "width")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=list(names))
        if out is not None:
            out.close()

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    dealt = keyed.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    local = written(dealt.mapInArrow(write, "part int, file string, offset long, length long, local_start long, n_tokens long, width int"), folder, "index_parts")
    # one row for each file: the count of files is that of the partitions
    bases, total = [], 0
    for r in local.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(bases, "part int, base long")
    index = local.join(F.broadcast(offsets), "part").select("file", "offset", "length", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "width")
    return folder, written(index, folder, "index")


def read_records(spark: SparkSession, folder: str, index: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of the records that the index rows name.

    The index may be any subset in any order; entries near each other in a file share one read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                entries = row["entries"]
                first, last = entries[0]["offset"], entries[-1]["offset"] + entries[-1]["length"]
                with files.open_input_file(f"{root}/{row['file']}") as f:
                    data = f.read_at(last - first, first)
                out: list[list] = [[], [], [], [], []]
                for e in entries:
                    payload = unframe(data, e["offset"] - first)
                    ids = np.frombuffer(payload, "<u2" if row["width"] == 2 else "<u4", offset=8).astype("<u4")
                    (i,) = struct.unpack_from("<q", payload)
                    for column, value in zip(out, (None if i == NULL_ID else i, e["start"], len(ids), zlib.crc32(ids.tobytes()), ids.view("<i4"))):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    entry = F.struct("offset", "length", "start")
    chunks = dealt_by_bytes(index, F.floor(F.col("offset") / chunk_bytes)).groupBy("file", "chunk", "width").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return chunks.select("file", "width", "entries").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
