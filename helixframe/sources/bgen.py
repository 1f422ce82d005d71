"""Reading and writing BGEN (layout 2)."""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.genotypes import hard_calls
from helixframe.sources.files import listed, opened, prepare_target, shared_folder, uri, write_single
from helixframe.stats.kernels import Made, lengths, slices

#: Bytes of a file that one task decodes, about.
SPLIT = 32 << 20
#: Of compression: on hard calls it takes a quarter of the time of zlib's own default, with less bytes.
LEVEL = 3


def file_header(f) -> tuple[int, int, int, int, list[str] | None]:
    """First variant's offset, variants, samples, compression and sample ids of a file."""
    f.seek(0)
    offset, length, variants, samples = struct.unpack("<IIII", f.read(16))
    f.seek(length)
    (flags,) = struct.unpack("<I", f.read(4))
    if (flags >> 2) & 15 != 2:
        raise ValueError("only BGEN layout 2 is supported")
    ids = None
    if flags >> 31:
        f.read(8)
        ids = [f.read(struct.unpack("<H", f.read(2))[0]).decode() for _ in range(samples)]
    return offset + 4, variants, samples, flags & 3, ids


def variant_head(f) -> tuple[str, str, str, int, list[str]]:
    text = lambda fmt: f.read(struct.unpack("<" + fmt, f.read(struct.calcsize(fmt)))[0]).decode()
    names = text("H"), text("H"), text("H")
    pos, k = struct.unpack("<IH", f.read(6))
    return *names, pos, [text("I") for _ in range(k)]


def chunks(path: str, index: bool) -> Iterator[tuple[int, int]]:
    """(offset, variants) of stretches of a file, from its .bgi index if there is one, else by skipping over blocks."""
    with opened(path) as f:
        at, variants, _, _, _ = file_header(f)
        if index:
            try:
                with opened(path + ".bgi") as g, tempfile.NamedTemporaryFile(suffix=".bgi", delete=False) as t:
                    t.write(g.read())
            except FileNotFoundError:
                pass
            else:
                with sqlite3.connect(t.name) as db:
                    places = [r[0] for r in db.execute("SELECT file_start_position FROM Variant ORDER BY file_start_position")]
                os.unlink(t.name)
                first, n = None, 0
                for p in places:
                    if first is None or p - first >= SPLIT:
                        if n:
                            yield first, n
                        first, n = p, 0
                    n += 1
                if n:
                    yield first, n
                return
        first, n = at, 0
        for _ in range(variants):
            f.seek(at)
            variant_head(f)
            (size,) = struct.unpack("<I", f.read(4))
            at = f.tell() + size
            n += 1
            if at - first >= SPLIT:
                yield first, n
                first, n = at, 0
        if n:
            yield first, n


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(float)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count].reshape(count, bits)
    return flat @ (2.0 ** np.arange(bits))


def probabilities(block: bytes) -> tuple[bool, list[int], list[list[float]]]:
    """phased, ploidies and probabilities of each sample; a missing sample has none."""
    n, k, _, _ = struct.unpack_from("<IHBB", block)
    ploidy = np.frombuffer(block, np.uint8, n, 8)
    phased, bits = struct.unpack_from("<BB", block, 8 + n)
    missing, ploidy = ploidy > 63, ploidy & 63
    sizes = np.array([p * (k - 1) if phased else comb(p + k - 1, k - 1) - 1 for p in range(64)])[ploidy]
    values = unpack(block[10 + n :], bits, int(sizes.sum())) / (2.0**bits - 1)
    ends = np.cumsum(sizes)
    out = []
    for i in range(n):
        v = values[ends[i] - sizes[i] : ends[i]]
        if missing[i]:
            out.append([])
        elif phased:
            parts = v.reshape(int(ploidy[i]), k - 1)
            out.append(np.column_stack([parts, 1 - parts.sum(1)]).ravel().tolist())
        else:
            out.append([*v.tolist(), float(1 - v.sum())])
    return bool(phased), ploidy.tolist(), out


def diploid_units(block: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Whether each sample is known, the stored numbers (samples, probabilities but the last) and their bits, of unphased diploid samples; else None."""
    n, k, least, most = struct.unpack_from("<IHBB", block)
    phased, bits = struct.unpack_from("<BB", block, 8 + n)
    if phased or (least, most) != (2, 2) or bits not in (8, 16, 32) or k < 2:
        return None
    width = comb(k + 1, 2) - 1
    ploidy = np.frombuffer(block, np.uint8, n, 8)
    return ploidy < 64, np.frombuffer(block, f"<u{bits // 8}", n * width, 10 + n).reshape(n, width), bits


def plain_block(data: bytes, compression: int) -> bytes:
    """A variant's genotypes as they are before compression."""
    if not compression:
        return data
    (plain,) = struct.unpack_from("<I", data)
    return zlib.decompress(data[4:], bufsize=plain) if compression == 1 else zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=plain)


def first_maximum(p: list[float], threshold: float) -> int:
    able = [x if x >= threshold and x > 0 else 0.0 for x in p]
    return max(range(len(p)), key=able.__getitem__) if any(able) else -1


def hard_call(p: list[float], ploidy: int, phased: bool, alleles: int, threshold: float) -> list[int] | None:
    """functions.hard_calls of one sample; samples that are not diploid have none."""
    if not len(p):
        return [-1, -1]
    if ploidy != 2:
        return None
    if phased:
        return [first_maximum(p[i * alleles : (i + 1) * alleles], threshold) for i in range(2)]
    at = first_maximum(p, threshold)
    high = int(((8 * at + 1) ** 0.5 - 1) / 2) if at >= 0 else -1
    return [at - high * (high + 1) // 2, high] if at >= 0 else [-1, -1]


def calls_of_block(block: bytes, threshold: float) -> np.ndarray | list:
    """The hard calls of a variant's samples: (samples, 2), or a list where some are not diploid."""
    held, (k,) = diploid_units(block), struct.unpack_from("<H", block, 4)
    if held is None:
        phased, ploidy, probs = probabilities(block)
        return [hard_call(p, own, phased, k, threshold) for p, own in zip(probs, ploidy)]
    known, units, bits = held
    p, rest = [], np.zeros(len(units))
    for column in units.T:
        p.append(column / (2.0**bits - 1))
        rest += p[-1]
    p.append(1 - rest)
    best, at = p[0], np.zeros(len(known), np.int8 if len(p) < 127 else np.int64)
    for i, x in enumerate(p[1:], 1):  # of equal ones the first
        at[x > best] = i
        best = np.maximum(best, x)
    at[~(known & (best >= threshold) & (best > 0))] = len(p)
    high = np.repeat(np.arange(k), np.arange(1, k + 1))
    pairs = np.stack([np.arange(len(high)) - high * (high + 1) // 2, high], axis=1)
    both = np.concatenate([pairs, [[-1, -1]]]).astype(np.int32).view(np.int64).reshape(-1)  # both calls are copied at once
    return both[at].view(np.int32).reshape(-1, 2)


def made_calls(threshold: float = 0.9) -> Made:
    """Hard calls, array<array<int>>, of the rows of read_bgen_blocks: decoded in the worker that looks at them."""

    def calls(blocks: pa.Array, compression: pa.Array) -> pa.Array:
        found = [calls_of_block(plain_block(b.as_buffer(), c), threshold) for b, c in zip(blocks, compression.to_pylist())]
        if not all(isinstance(x, np.ndarray) for x in found):
            return pa.array([x if isinstance(x, list) else x.tolist() for x in found], pa.list_(pa.list_(pa.int32())))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([x.reshape(-1) for x in found]) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat)))

    return Made(calls, [F.col("block"), F.col("compression")], 1)


SITE = "contigName string, start long, end long, names array<string>, referenceAllele string, alternateAlleles array<string>"


def bgen_files(spark: SparkSession, path: str, ignore_extension: bool) -> list[str]:
    return [p for p, _ in listed(spark, path) if (ignore_extension or p.endswith(".bgen")) and not p.endswith(".bgi")]


def stretches(spark: SparkSession, paths: list[str], use_index: bool) -> DataFrame:
    """A row (path, at, n) for each stretch of variants that a task reads: as many tasks as stretches, which a shuffle by keys alone would merge into one."""

    def cut(parts):
        for pdf in parts:
            rows = [(p, at, n) for p in pdf["path"] for at, n in chunks(p, use_index)]
            yield type(pdf)(rows, columns=["path", "at", "n"])

    kind = "path string, at long, n long"
    found = spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(cut, kind).collect()  # a row for each SPLIT bytes
    return spark.createDataFrame(found, kind).repartition(max(1, len(found)))


def variants_of(r: dict, given: list[str] | None) -> Iterator[tuple[int, list[str] | None, int, tuple, bytes]]:
    """samples, their ids, compression, site and data of the variants of a stretch."""
    with opened(r["path"]) as f:
        _, _, samples, compression, own = file_header(f)
        ids = given or own
        if ids and len(ids) != samples:
            raise ValueError(f"{r['path']} has {samples} samples, {len(ids)} ids were given")
        f.seek(r["at"])
        for _ in range(r["n"]):
            site = variant_head(f)
            (size,) = struct.unpack("<I", f.read(4))
            yield samples, ids, compression, site, f.read(size)


def site_columns(sites: list[tuple]) -> dict[str, pa.Array]:
    texts = lambda x: pa.array(x, pa.list_(pa.string()))
    starts = [pos - 1 for _, _, _, pos, _ in sites]
    return {
        "contigName": pa.array([x[2] for x in sites], pa.string()), "start": pa.array(starts, pa.int64()), "end": pa.array([s + len(x[4][0]) for s, x in zip(starts, sites)], pa.int64()),
        "names": texts([list(x[:2]) for x in sites]), "referenceAllele": pa.array([x[4][0] for x in sites], pa.string()), "alternateAlleles": texts([x[4][1:] for x in sites]),
    }


def read_bgen_blocks(spark: SparkSession, path: str, use_index: bool = True, ignore_extension: bool = False) -> DataFrame:
    """The sites of read_bgen with compression and block, the genotypes as the file holds them.

    A kernel over made_calls decodes them where they are used, so no genotype is a row's value in the JVM.
    """
    paths, schema = bgen_files(spark, path, ignore_extension), f"{SITE}, compression int, block binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held_rows(held: list) -> pa.RecordBatch:
            columns = site_columns([x[3] for x in held]) | {"compression": pa.array([x[2] for x in held], pa.int32()), "block": pa.array([x[4] for x in held], pa.binary())}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for r in batch.to_pylist():
                held: list[tuple] = []
                for x in variants_of(r, None):
                    held.append(x)
                    if len(held) == 256 or sum(len(h[4]) for h in held[-1:]) > 1 << 20:
                        yield held_rows(held)
                        held = []
                if held:
                    yield held_rows(held)

    return stretches(spark, paths, use_index).mapInArrow(read, schema) if paths else spark.createDataFrame([], schema)


def read_bgen(spark: SparkSession, path: str, use_index: bool = True, ignore_extension: bool = False, sample_file: str | None = None, sample_id_column: str = "ID_2", emit_hard_calls: bool = True, hard_call_threshold: float = 0.9, include_sample_ids: bool = True) -> DataFrame:
    """One row for each variant, with probabilities and, unless refused, hard calls of diploid samples."""
    paths = bgen_files(spark, path, ignore_extension)
    given = None
    if sample_file:
        with opened(sample_file) as f:
            table = [x.split() for x in f.read().decode().splitlines() if x]
        if sample_id_column not in table[0]:
            raise ValueError(f"sample file {sample_file} has no column {sample_id_column}")
        given = [r[table[0].index(sample_id_column)] for r in table[2:]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("sampleId", pa.string())] if include_sample_ids else []
        kinds += [("phased", pa.bool_()), ("ploidy", pa.int32()), ("posteriorProbabilities", pa.list_(pa.float64()))]
        for batch in batches:
            for r in batch.to_pylist():
                for samples, ids, compression, site, data in variants_of(r, given if include_sample_ids else None):
                    phased, ploidy, probs = probabilities(plain_block(data, compression))
                    parts = [pa.array(ids or [None] * samples, pa.string())] if include_sample_ids else []
                    parts += [pa.array([phased] * samples), pa.array(ploidy, pa.int32()), pa.array(probs, pa.list_(pa.float64()))]
                    structs = pa.StructArray.from_arrays(parts, fields=[pa.field(*k) for k in kinds])
                    columns = site_columns([site]) | {"genotypes": pa.ListArray.from_arrays(pa.array([0, samples], pa.int32()), structs)}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    first = "sampleId:string," if include_sample_ids else ""
    schema = f"{SITE}, genotypes array<struct<{first}phased:boolean,ploidy:int,posteriorProbabilities:array<double>>>"
    if not paths:
        out = spark.createDataFrame([], schema)
    else:
        out = stretches(spark, paths, use_index).mapInArrow(read, schema)
    if emit_hard_calls:
        alts = F.size("alternateAlleles")
        calls = lambda g: F.when(F.size(g["posteriorProbabilities"]) == 0, F.array(F.lit(-1), F.lit(-1))).otherwise(F.when(g["ploidy"] == 2, hard_calls(g["posteriorProbabilities"], alts, g["phased"], hard_call_threshold)))
        ids = lambda g: [g["sampleId"].alias("sampleId")] if include_sample_ids else []
        out = out.withColumn("genotypes", F.transform("genotypes", lambda g: F.struct(*ids(g), g["phased"].alias("phased"), calls(g).alias("calls"), g["ploidy"].alias("ploidy"), g["posteriorProbabilities"].alias("posteriorProbabilities"))))
    return out


def whole_numbers(p: np.ndarray, bits: int) -> np.ndarray:
    """Integers in units of 2^bits - 1 with the sum kept: the largest fractions are rounded up."""
    v = p * (2.0**bits - 1)
    low = np.floor(v)
    fraction = v - low
    up = fraction.sum()
    rank = np.empty(len(v))
    rank[np.argsort(-fraction, kind="stable")] = np.arange(len(v))
    return (low + (rank < up - 1e-9)).astype(np.uint64)


def infer_ploidy(n: int, k: int, phased: bool, most: int, default: int) -> int:
    """The ploidy that so many probabilities of k alleles stand for."""
    if n == 0:
        return default
    for p in range(1, most + 1):
        if n == (p * k if phased else comb(p + k - 1, k - 1)):
            return p
    raise ValueError(f"cannot infer the ploidy of {n} probabilities of {k} alleles")


def variant_text(names: list[str] | None, contig: str, start: int, alleles: list[str]) -> bytes:
    names = [*(names or []), "", ""][:2]
    text = lambda s, fmt: struct.pack("<" + fmt, len(s.encode())) + s.encode()
    return text(names[0], "H") + text(names[1], "H") + text(contig, "H") + struct.pack("<IH", start + 1, len(alleles)) + b"".join(text(a, "I") for a in alleles)


def compressed(data: bytes) -> bytes:
    packed = zlib.compress(data, LEVEL)
    return struct.pack("<II", len(packed) + 4, len(data)) + packed


def encoded(row: dict, bits: int, most: int, ploidy: int, phasing: bool) -> bytes:
    alleles = [row["referenceAllele"], *(row["alternateAlleles"] or [])]
    return variant_text(row.get("names"), row["contigName"], row["start"], alleles) + encoded_genotypes(row["genotypes"] or [], len(alleles), bits, most, ploidy, phasing)


def encoded_genotypes(genotypes: list[dict], k: int, bits: int, most: int, ploidy: int, phasing: bool) -> bytes:
    phased = next((g["phased"] for g in genotypes if g.get("phased") is not None), phasing)
    ploidies, parts = [], []
    for g in genotypes:
        p = g.get("posteriorProbabilities")
        p = [] if p is None else p
        known = g.get("ploidy")
        own = known if known is not None else infer_ploidy(len(p), k, phased, most, ploidy)
        count = own * k if phased else comb(own + k - 1, k - 1)
        ploidies.append(own | (0x80 if len(p) == 0 else 0))
        values = np.asarray(p, float) if len(p) else np.zeros(count)
        groups = values.reshape(own, k) if phased else values.reshape(1, -1)
        parts += [(whole_numbers(x, bits) if len(p) else np.zeros(len(x), np.uint64))[:-1] for x in groups]
    plain = [x & 63 for x in ploidies] or [ploidy]
    data = struct.pack("<IHBB", len(genotypes), k, min(plain), max(plain)) + bytes(ploidies) + struct.pack("<BB", phased, bits)
    data += (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype(f"<u{bits // 8}").tobytes()
    return compressed(data)


def diploid_encoded(genotypes: pa.StructArray, k: int, bits: int, default: int, phasing: bool) -> bytes | None:
    """encoded_genotypes of unphased diploid samples that have no probabilities or one for each pair of alleles; None of others."""
    names = [f.name for f in genotypes.type]
    if not len(genotypes) or genotypes.null_count or k < 2 or "posteriorProbabilities" not in names:
        return None
    field = lambda n: genotypes.field(n) if n in names and genotypes.field(n).null_count < len(genotypes) else None
    phased, ploidy = field("phased"), field("ploidy")
    if phasing if phased is None else phased.null_count or phased.true_count:
        return None
    if default != 2 if ploidy is None else ploidy.null_count or (ploidy.to_numpy(zero_copy_only=False) != 2).any():
        return None
    p = genotypes.field("posteriorProbabilities")
    if p.null_count or p.type.value_type != pa.float64():
        return None
    width, flat = comb(k + 1, 2), p.flatten()
    counts = np.diff(p.offsets.to_numpy())
    known = counts > 0
    if flat.null_count or len(flat) != width * np.count_nonzero(known) or (counts[known] != width).any():
        return None
    v = flat.to_numpy().reshape(-1, width) * (2.0**bits - 1)
    units = np.floor(v)
    if (units != v).any():  # the largest fractions are rounded up, as in whole_numbers
        fraction = v - units
        up, order = fraction.sum(1), np.argsort(-fraction, axis=1, kind="stable")
        rank = np.empty_like(v)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(width, dtype=float), v.shape), 1)
        units += rank < up[:, None] - 1e-9
    stored = np.zeros((len(genotypes), width - 1), f"<u{bits // 8}")
    at = np.flatnonzero(known)
    for i in range(width - 1):
        stored[at, i] = units[:, i]
    data = struct.pack("<IHBB", len(genotypes), k, 2, 2) + np.where(known, 2, 0x82).astype(np.uint8).tobytes() + struct.pack("<BB", 0, bits)
    return compressed(data + stored.tobytes())


#: Bytes of encoded variants after which a task of write_bgen begins another file.
FILE_BYTES = 64 << 20


def shared_ids(df: DataFrame) -> list[str]:
    """The rows' sample ids if all of them have the same."""
    if "sampleId" not in df.schema["genotypes"].dataType.elementType.fieldNames():
        return []
    found = df.select(F.col("genotypes.sampleId").alias("s")).distinct().limit(2).collect()
    return found[0]["s"] if len(found) == 1 and found[0]["s"] and all(found[0]["s"]) else []


def file_head(variants: int, samples: int, ids: list[str]) -> bytes:
    listed_ids = b"".join(struct.pack("<H", len(i.encode())) + i.encode() for i in ids)
    block = struct.pack("<II", 8 + len(listed_ids), len(ids)) + listed_ids if ids else b""
    flags = 1 | 2 << 2 | (1 << 31 if ids else 0)
    return struct.pack("<IIII4sI", 20 + len(block), 20, variants, samples, b"bgen", flags) + block


def _checked(bits: int) -> None:
    if bits not in (8, 16, 32):
        raise ValueError("bits_per_probability must be 8, 16 or 32")


def _encoder(bits: int, most: int, ploidy: int, phasing: bool):
    _checked(bits)
    return lambda row: encoded(row, bits, most, ploidy, phasing)


def packer(bits: int, most: int, ploidy: int, phasing: bool, made: Made | None):
    """A kernel from counts of alleles, and genotypes or what they are made of, to struct(n, data): samples and their genotypes as BGEN holds them."""

    def packed(k: pa.Array, *given: pa.Array) -> pa.Array:
        counts, out, at = [], [], 0
        for _, genotypes in slices(pa.RecordBatch.from_arrays(list(given), names=[str(i) for i in range(len(given))]), made):
            flat, sizes = genotypes.flatten(), lengths(genotypes)
            ends = np.cumsum(sizes)
            for end, n in zip(ends.tolist(), sizes.tolist()):
                own, alleles = flat.slice(end - n, n), k[at].as_py()
                data = diploid_encoded(own, alleles, bits, ploidy, phasing)
                out.append(encoded_genotypes(own.to_pylist(), alleles, bits, most, ploidy, phasing) if data is None else data)
                counts.append(n)
                at += 1
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(out, pa.binary())], names=["n", "data"])

    return packed


def write_bgen(
    df: DataFrame, path: str, bits_per_probability: int = 16, maximum_inferred_ploidy: int = 10, default_inferred_ploidy: int = 2, default_inferred_phasing: bool = False, mode: str = "error",
    *, genotypes: Made | None = None, sample_ids: list[str] | None = None,
) -> DataFrame:
    """A folder of BGEN files that the tasks write themselves, each whole; returns (file, variants).

    A row's samples must be as many as in all other rows. A repeated attempt writes files of its own; those
    of lost attempts are removed at the end. Genotypes are encoded in the worker that holds them; they may be made there, of other columns of df.
    Without sample_ids, the rows' own are written if all rows share them.
    """
    _checked(bits_per_probability)
    if not prepare_target(path, mode):
        return df.sparkSession.createDataFrame([], "file string, variants long")
    ids = sample_ids or (shared_ids(df) if genotypes is None else [])
    encode = F.arrow_udf(packer(bits_per_probability, maximum_inferred_ploidy, default_inferred_ploidy, default_inferred_phasing, genotypes), "n int, data binary").asNondeterministic()
    alleles = F.concat(F.array("referenceAllele"), F.coalesce("alternateAlleles", F.array().cast("array<string>")))
    of = [F.col("genotypes")] if genotypes is None else genotypes.columns
    sites = [F.col("names") if "names" in df.columns else F.lit(None).cast("array<string>").alias("names"), F.col("contigName"), F.col("start"), alleles.alias("alleles")]
    rows = df.select(*sites, encode(F.size(alleles), *of).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri(path))
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []
        size, least, most = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bgen"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(file_head(len(held), most, ids))
                for x in held:
                    f.write(x)
            told = pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (len(held), least, most))], names=["file", "variants", "least", "most"])
            held, size = [], 0
            return told

        for batch in batches:
            texts = [variant_text(*x.values()) for x in batch.select(["names", "contigName", "start", "alleles"]).to_pylist()]
            encoded = batch.column("e")
            for text, n, data in zip(texts, encoded.field("n").to_pylist(), encoded.field("data")):
                least, most = (min(least, n), max(most, n)) if held else (n, n)
                held.append(text + data.as_py())
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    made = rows.mapInArrow(run, "file string, variants long, least long, most long").collect()  # a row for each file
    fs, root = pafs.FileSystem.from_uri(uri(path))
    fs.create_dir(root, recursive=True)
    least, most = min((r["least"] for r in made), default=0), max((r["most"] for r in made), default=0)
    known = {r["file"] for r in made} if least == most else set()
    for x in fs.get_file_info(pafs.FileSelector(root)):
        if x.base_name.endswith(".bgen") and x.base_name not in known:
            fs.delete_file(x.path)
    if least != most:
        raise ValueError(f"rows have from {least} to {most} samples")
    return df.sparkSession.createDataFrame([(r["file"], r["variants"]) for r in made], "file string, variants long")


def write_bigbgen(df: DataFrame, path: str, bits_per_probability: int = 16, maximum_inferred_ploidy: int = 10, default_inferred_ploidy: int = 2, default_inferred_phasing: bool = False, mode: str = "error") -> None:
    """One BGEN file in the order of df's partitions, zlib-compressed, with sample ids if all rows share them."""
    encode = _encoder(bits_per_probability, maximum_inferred_ploidy, default_inferred_ploidy, default_inferred_phasing)
    if not prepare_target(path, mode):
        return
    facts = df.agg(F.count("*").alias("n"), F.max(F.size("genotypes")).alias("samples")).first()
    head = file_head(facts["n"], max(0, facts["samples"] or 0), shared_ids(df))
    write_single(df, path, lambda rows: map(encode, rows), head, b"", False, shared_folder(df.sparkSession))
