"""Formats by name for spark.read and df.write: `vcf` as a Python data source.

Comparisons of contigName, start and end that Spark pushes become one interval. A block-gzip file with
an index beside it is then read in the stretches that hold the interval; other files are dealt in byte
ranges and their lines are dropped before they are parsed. Spark checks all filters again.

Writers of partitions put their files below a folder of the job; the commit moves them into place,
and an abort or a lost attempt leaves nothing in the target. Such sources get no column pruning:
read_vcf, with a region, is faster where few columns are used.
"""

from __future__ import annotations

import gzip
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from helixframe.sources import vcf_header as H
from helixframe.sources.files import BGZF_END, SPLIT, bgzf_compress, bgzf_lines, is_bgzf, opened, uri
from helixframe.sources.tabix import LIMIT, Interval, index_of, stretch_lines, stretches, within
from helixframe.sources.vcf_write import check, header_lines

BATCH = 1024


def interval_of(filters: list[D.Filter]) -> Interval | None:
    """The smallest interval that all rows which pass the filters overlap; None if no row can pass.

    A row with its start between two places overlaps these, and so does one with its end between two;
    each bounds the other, as a start is before its end.
    """
    contig, starts, ends = None, [0, LIMIT - 1], [1, LIMIT]
    for f in filters:
        name, value = getattr(f, "attribute", ("",)), getattr(f, "value", None)
        if name == ("contigName",) and isinstance(f, (D.EqualTo, D.EqualNullSafe)) and value is not None:
            if contig not in (None, value):
                return None
            contig = value
        if name in (("start",), ("end",)) and isinstance(value, int):
            held = starts if name == ("start",) else ends
            low = {D.EqualTo: value, D.EqualNullSafe: value, D.GreaterThanOrEqual: value, D.GreaterThan: value + 1}.get(type(f))
            high = {D.EqualTo: value, D.EqualNullSafe: value, D.LessThanOrEqual: value, D.LessThan: value - 1}.get(type(f))
            held[0] = max(held[0], low) if low is not None else held[0]
            held[1] = min(held[1], high) if high is not None else held[1]
    starts[1], ends[0] = min(starts[1], ends[1] - 1), max(ends[0], starts[0] + 1)
    if starts[0] > starts[1] or ends[0] > ends[1]:
        return None
    by_start, by_end = (starts[0], starts[1] + 1), (ends[0] - 1, ends[1])
    low, high = min(by_start, by_end, key=lambda x: x[1] - x[0])
    return Interval(contig, low, high)


def files_at(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files of a path, folder or glob of names in one folder."""
    fs, p = pafs.FileSystem.from_uri(uri(path))
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        found = [info]
    elif info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
    else:
        import fnmatch

        found = [x for x in fs.get_file_info(pafs.FileSelector(p.rpartition("/")[0], allow_not_found=True)) if fnmatch.fnmatch(x.path, p)]
    scheme = uri(path).partition("://")[0]
    hidden = lambda x: any(part[:1] in "._" for part in x.path[len(p) :].split("/") if part)
    return sorted((f"{scheme}://{x.path}", x.size) for x in found if x.type == pafs.FileType.File and not x.path.endswith(".tbi") and not hidden(x))


@dataclass
class Part(D.InputPartition):
    path: str
    kind: str  # stretch, block, text or gzip
    start: int
    end: int
    size: int


def text_range(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines of a plain file that begin in a byte range."""
    with opened(path) as raw:
        raw.seek(max(0, start - 1))
        f = io.BufferedReader(raw, 1 << 20)
        at = max(0, start - 1)
        if start > 0:
            at += len(f.readline())
        while at < end and (line := f.readline()):
            at += len(line)
            yield line.rstrip(b"\n")


class RowParser:
    """Lines of one header as rows of a schema; the rules are those of read_vcf."""

    def __init__(self, header: H.Header, schema: T.StructType, strict: bool):
        self.header, self.schema, self.strict = header, schema, strict
        kind = schema["genotypes"].dataType.elementType
        self.fields, self.with_ids = {f.name: f.dataType for f in kind}, "sampleId" in kind.fieldNames()

    def scalar(self, x: str | None, kind: T.DataType):
        if x in (None, "", "."):
            return None
        try:
            if isinstance(kind, T.DoubleType):
                low = x.lower()
                return math.nan if low in ("nan", "+nan", "-nan") else float(x)
            if isinstance(kind, T.IntegerType):
                value = int(x)
                if not -(2**31) <= value < 2**31:
                    raise ValueError(f"{x} is no 32-bit number")
                return value
            return x
        except ValueError:
            if self.strict:
                raise
            return None

    def array(self, x: str | None, kind: T.DataType, by: str = ","):
        if x in (None, "", "."):
            return None
        values = [self.scalar(v, kind) for v in x.split(by)]
        return values if any(v is not None for v in values) else []

    def value(self, x: str | None, kind: T.DataType):
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                return None if x is None else [self.effect(e.split("|"), kind.elementType) for e in x.split(",")]
            return self.array(x, kind.elementType)
        return self.scalar(x, kind)

    def effect(self, parts: list[str], kind: T.StructType) -> dict:
        out = {}
        for i, f in enumerate(kind):
            text = parts[i] if i < len(parts) and parts[i] else None
            if text is None or isinstance(f.dataType, T.StringType):
                out[f.name] = text
            elif isinstance(f.dataType, T.ArrayType):
                out[f.name] = text.split("&")
            elif isinstance(f.dataType, T.StructType):
                both = text.split("/")
                out[f.name] = {g.name: self.scalar(both[k] if k < len(both) else None, g.dataType) for k, g in enumerate(f.dataType)}
            else:
                out[f.name] = self.scalar(text, f.dataType)
        return out

    def genotype(self, text: str, keys: list[str], i: int) -> dict:
        out = dict.fromkeys(self.fields)
        if self.with_ids:
            out["sampleId"] = self.header.samples[i]
        for key, x in zip(keys, text.split(":")):
            if key not in self.header.format:
                continue
            if key == "GT":
                if x:
                    out["phased"] = "|" in x
                    out["calls"] = [int(c) if c.isdigit() else -1 for c in x.replace("|", "/").split("/")]
            else:
                name = H.ALIASES.get(key, key)
                out[name] = self.array(x, T.StringType(), ";") if key == "FT" else self.value(x, self.fields[name])
        return out

    def row(self, line: str) -> dict:
        c = line.rstrip("\r").split("\t")
        items: dict[str, str] = {}
        for x in c[7].split(";") if len(c) > 7 else ():
            key, eq, value = x.partition("=")
            if x not in ("", "."):
                items.setdefault(key, value if eq else "")
        start, text = int(c[1]) - 1, T.StringType()
        end = items.get("END", "")
        out = {
            "contigName": self.scalar(c[0], text), "start": start, "end": int(end) if end.isdigit() else start + len(c[3]), "names": self.array(c[2], text, ";"), "referenceAllele": self.scalar(c[3], text),
            "alternateAlleles": self.array(c[4], text), "qual": self.scalar(c[5], T.DoubleType()) if len(c) > 5 else None, "filters": self.array(c[6], text, ";") if len(c) > 6 else None, "splitFromMultiAllelic": False,
        }
        for f in self.schema:
            if f.name.startswith("INFO_"):
                key = f.name.removeprefix("INFO_")
                out[f.name] = key in items if isinstance(f.dataType, T.BooleanType) else self.value(items.get(key), f.dataType)
            elif f.name == "attributes":
                out[f.name] = list(items.items())
        samples = c[9 : 9 + len(self.header.samples)]
        keys = c[8].split(":") if len(c) > 8 else []
        out["genotypes"] = [self.genotype(s, keys, i) for i, s in enumerate(samples)] if samples else None
        return out


class VcfReader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, options: dict) -> None:
        self.path, self.schema = path, schema
        self.strict = options.get("validationstringency", "silent").lower() == "strict"
        self.use_index = options.get("usetabixindex", "true").lower() == "true"
        self.use_filters = options.get("usefilterparser", "true").lower() == "true"
        self.want: Interval | None = Interval()

    def pushFilters(self, filters: list[D.Filter]):
        if self.use_filters:
            self.want = interval_of(filters)
        return filters  # Spark checks all of them

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        if self.want is None:
            return [Part("", "none", 0, 0, 0)]
        for path, size in files_at(self.path):
            with opened(path) as f:
                head = f.read(18)
            if not is_bgzf(head):
                ranges = [("gzip", 0, size)] if head[:2] == b"\x1f\x8b" else [("text", s, min(size, s + SPLIT)) for s in range(0, size, SPLIT)]
            elif self.use_index and self.want != Interval() and (index := index_of(path)) is not None:
                ranges = [("stretch", *x) for x in stretches(index, self.want)]
            else:
                ranges = [("block", s, min(size, s + SPLIT)) for s in range(0, size, SPLIT)]
            out += [Part(path, kind, s, e, size) for kind, s, e in ranges]
        return out or [Part("", "none", 0, 0, 0)]

    def lines(self, p: Part) -> Iterator[bytes]:
        if p.kind == "stretch":
            yield from stretch_lines(p.path, p.start, p.end)
        elif p.kind == "block":
            yield from bgzf_lines(p.path, p.start, p.end, p.size)
        elif p.kind == "text":
            yield from text_range(p.path, p.start, p.end)
        elif p.kind == "gzip":
            with opened(p.path) as f, gzip.GzipFile(fileobj=f) as z:
                yield from (x.rstrip(b"\n") for x in z)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        if partition.kind == "none":
            return
        parser, held = RowParser(H.parse(H.head_of(partition.path)), self.schema, self.strict), []
        for line in self.lines(partition):
            if line and not line.startswith(b"#") and (self.want == Interval() or within(line, self.want)):
                held.append(parser.row(line.decode()))
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, kind)
                held = []
        yield pa.RecordBatch.from_pylist(held, kind)


def text_of(x, kind: T.DataType) -> str:
    """A value as VCF has it."""
    if x is None:
        return "."
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            part = lambda v, k: "" if v is None else "&".join(v) if isinstance(k, T.ArrayType) else "/".join(str(y) for y in v if y is not None) if isinstance(k, T.StructType) else str(v)
            return ",".join("|".join(part(e[f.name], f.dataType) for f in kind.elementType) for e in x)
        return ",".join(text_of(v, kind.elementType) for v in x) or "."
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else str(x)
    return str(x)


class LineWriter:
    """Rows of a schema as VCF lines."""

    def __init__(self, schema: T.StructType):
        check(schema)
        self.schema, self.names = schema, schema.fieldNames()
        kind = schema["genotypes"].dataType.elementType if "genotypes" in self.names else T.StructType()
        self.fields = sorted((f for f in kind if f.name not in ("sampleId", "phased", "otherFields")), key=lambda f: f.name != "calls")
        self.phased, self.ids = "phased" in kind.fieldNames(), {v: k for k, v in H.ALIASES.items()}

    def get(self, row, name: str):
        return row[name] if name in self.names else None

    def cell(self, g, f: T.StructField) -> str:
        x = g[f.name]
        if f.name == "calls":
            return ("|" if self.phased and g["phased"] else "/").join("." if c < 0 else str(c) for c in x) if x else "."
        return ";".join(x) if f.name == "filters" and x else text_of(x, f.dataType)

    def line(self, row) -> str:
        info = []
        for f in self.schema:
            if f.name.startswith("INFO_") and row[f.name] is not None:
                key = f.name.removeprefix("INFO_")
                if isinstance(f.dataType, T.BooleanType):
                    info += [key] if row[f.name] else []
                else:
                    info.append(f"{key}={text_of(row[f.name], f.dataType)}")
        if row["end"] is not None and row["end"] != row["start"] + len(row["referenceAllele"] or ""):
            info.append(f"END={row['end']}")
        info += [k if not v else f"{k}={v}" for k, v in (self.get(row, "attributes") or {}).items()]
        joined = lambda x, by: by.join(x) if x else "."
        out = [
            row["contigName"] or ".", str(row["start"] + 1), joined(self.get(row, "names"), ";"), row["referenceAllele"] or ".", joined(self.get(row, "alternateAlleles"), ","),
            text_of(self.get(row, "qual"), T.DoubleType()), joined(self.get(row, "filters"), ";"), ";".join(info) or ".",
        ]
        genotypes = self.get(row, "genotypes")
        if genotypes:
            used = [f for f in self.fields if any(g[f.name] is not None for g in genotypes)]
            out.append(":".join("GT" if f.name == "calls" else self.ids.get(f.name, f.name) for f in used) or ".")
            out += [":".join(self.cell(g, f) for f in used) or "." for g in genotypes]
        return "\t".join(out)


@dataclass
class Written(D.WriterCommitMessage):
    name: str | None
    samples: tuple[str, ...] | None


class VcfWriter(D.DataSourceWriter):
    """A file for each partition, moved into place by the commit."""

    def __init__(self, path: str, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = uri(path).rstrip("/"), schema, overwrite
        self.packed = options.get("compression", "none").lower() in ("bgzf", "bgzip", "gzip")
        self.job = f"_temporary-{uuid.uuid4().hex}"
        check(schema)
        LineWriter(schema)

    def write(self, iterator: Iterator[T.Row]) -> Written:
        from pyspark import TaskContext

        writer, out, samples = LineWriter(self.schema), None, None
        fs, root = pafs.FileSystem.from_uri(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.vcf{'.bgz' if self.packed else ''}"
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            data = "".join(held).encode()
            out.write(bgzf_compress(data) if self.packed else data)
            held, size = [], 0

        for row in iterator:
            genotypes = writer.get(row, "genotypes")
            own = tuple((g["sampleId"] if "sampleId" in g and g["sampleId"] else f"sample_{i + 1}") for i, g in enumerate(genotypes)) if genotypes else ()
            if out is None:
                samples = own
                fs.create_dir(f"{root}/{self.job}", recursive=True)
                out = fs.open_output_stream(f"{root}/{self.job}/{name}", compression=None)
                columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
                held.append("\n".join([*header_lines(self.schema), "\t".join(columns)]) + "\n")
            if own != samples:
                raise ValueError("rows of a partition have different samples")
            held.append(writer.line(row) + "\n")
            size += len(held[-1])
            if size > 4 << 20:
                flush()
        if out is not None:
            flush()
            if self.packed:
                out.write(BGZF_END)
            out.close()
        return Written(name if out is not None else None, samples)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if not x.path.endswith(self.job):
                    fs.delete_file(x.path) if x.type == pafs.FileType.File else fs.delete_dir(x.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/{self.job}/{m.name}", f"{root}/{m.name}")
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class VcfSource(D.DataSource):
    """spark.read.format("vcf"), df.write.format("vcf")."""

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return self.options["path"]

    def schema(self) -> T.StructType:
        heads = {"\n".join(H.head_of(p)) for p, _ in files_at(self._path())}
        if not heads:
            raise ValueError(f"no VCF files in {self._path()}")
        given = lambda name: self.options.get(name, "true").lower() == "true"
        return H.schema(H.merged([H.parse(h.split("\n")) for h in sorted(heads)]), given("includeSampleIds"), given("flattenInfoFields"))

    def reader(self, schema: T.StructType) -> VcfReader:
        if "splitToBiallelic" in self.options:
            raise ValueError("splitToBiallelic is gone; use split_multiallelics")
        return VcfReader(self._path(), schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> VcfWriter:
        return VcfWriter(self._path(), schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register_formats(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets Spark push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfSource)
