"""Partitions through a command: rows to its standard input, its standard output to rows.

Output is read as it comes, in blocks of lines, while a thread feeds the input; both wait for each other
through the pipes, so a task holds a block of either, whatever passes through. Where results or inputs
have to outlive a task they are files of the shared folder.
"""

from __future__ import annotations

import os
import queue
import subprocess
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources import vcf_header as H
from helixframe.sources.files import shared_folder
from helixframe.sources.vcf import rows as vcf_rows
from helixframe.sources.vcf_write import full_header
from helixframe.sources.vcf_write import lines as vcf_lines

#: Characters of output lines that are handed on together.
BLOCK = 1 << 20
_held: list[str] = []


def streamed(cmd: list[str], env: dict[str, str], head: list[str], values: Iterator[str | None]) -> Iterator[list[str]]:
    """Blocks of the command's output lines; null values are skipped. A failed run raises at its end."""
    process = subprocess.Popen(cmd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={**os.environ, **env})
    errors: queue.SimpleQueue[bytes] = queue.SimpleQueue()
    broken: list[BaseException] = []

    def drain() -> None:
        last = b""
        while chunk := process.stderr.read1(1 << 16):
            last = (last + chunk)[-4000:]
        errors.put(last)

    def feed() -> None:
        try:
            for line in head:
                process.stdin.write(line.encode() + b"\n")
            for v in values:
                if v is not None:
                    process.stdin.write(v.encode() + b"\n")
        except BrokenPipeError:
            pass
        except BaseException as e:  # told by the reading side
            broken.append(e)
        finally:
            try:
                process.stdin.close()
            except BrokenPipeError:
                pass

    threads = [threading.Thread(target=f, daemon=True) for f in (drain, feed)]
    for t in threads:
        t.start()
    try:
        held, size = [], 0
        for line in process.stdout:
            held.append(line.removesuffix(b"\n").decode())
            size += len(line)
            if size >= BLOCK:
                yield held
                held, size = [], 0
        if held:
            yield held
        for t in threads:
            t.join()
        status = process.wait()
    finally:
        if process.poll() is None:  # not all output was wanted
            process.kill()
            process.wait()
    if broken:
        raise broken[0]
    if status != 0:
        raise RuntimeError(f"Subprocess exited with status {status}. Command ran: {' '.join(cmd)}. Error output: {errors.get().decode(errors='replace')}")


def through(lines: DataFrame, cmd: list[str], env: dict[str, str], head: list[str], spool: str | None = None) -> DataFrame:
    """Rows (value) of the command's output for each partition that has rows; a failed run raises.

    lines has the input in its first column. With a spool folder, the other columns of a partition are kept
    there, and are left there if its run fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        out = sink = None
        if spool:
            fs, root = pafs.FileSystem.from_uri(spool)
            fs.create_dir(root, recursive=True)
            kept = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
            out = fs.open_output_stream(f"{kept}.part", compression=None)
            sink = pa.ipc.new_stream(out, pa.schema(list(first.schema)[1:]))

        def values() -> Iterator[str | None]:
            for b in (x for some in ((first,), batches) for x in some):
                if sink is not None:
                    sink.write_batch(pa.RecordBatch.from_arrays(b.columns[1:], schema=sink_schema))
                yield from b.column(0).to_pylist()

        sink_schema = pa.schema(list(first.schema)[1:])
        given = values()
        try:
            for block in streamed(cmd, env, head, given):
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], names=["value"])
        except RuntimeError:
            if sink is not None:
                for _ in given:  # what the command did not take
                    pass
                sink.close()
                out.close()
                fs.move(f"{kept}.part", f"{kept}.failed")
            raise
        if sink is not None:
            sink.close()
            out.close()
            fs.delete_file(f"{kept}.part")

    return lines.mapInArrow(run, "value string")


def quarantined(spool: str, df: DataFrame) -> DataFrame | None:
    """The input rows of the partitions whose runs failed, each partition once."""
    fs, root = pafs.FileSystem.from_uri(spool)
    files = {x.base_name.partition("-")[0]: x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".failed")}
    if not files:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    yield from pa.ipc.open_stream(f)

    spark = df.sparkSession
    return spark.createDataFrame([(p,) for p in sorted(files.values())], "path string").repartition(len(files), "path").mapInArrow(read, df.schema)


def pipe(df: DataFrame, cmd: list[str], input_formatter: str = "text", output_formatter: str = "text", env: dict[str, str] | None = None, in_header: str | None = None, in_vcf_header: str = "infer", out_ignore_header: bool = False, quarantine_table: str | None = None, quarantine_flavor: str = "csv") -> DataFrame:
    """df's partitions through a command.

    Text takes one column of strings and gives the column text; vcf takes variant rows and gives
    them as the output's header says, which is why the command then runs at once, its output a table of
    the shared folder until pipe_cleanup(). If a run fails and a quarantine table is named, the rows of the
    partitions that failed are saved there before the error is raised.
    """
    if input_formatter == "text":
        if len(df.columns) != 1:
            raise ValueError(f"text is made of one column, not of {len(df.columns)}")
        lines = df.select(F.col(df.columns[0]).cast("string").alias("value"))
        head = [in_header] if in_header else []
    elif input_formatter == "vcf":
        lines, head = vcf_lines(df), full_header(df, in_vcf_header, None).split("\n")
    else:
        raise ValueError(f"no input formatter {input_formatter}; there are text and vcf")
    if output_formatter not in ("text", "vcf"):
        raise ValueError(f"no output formatter {output_formatter}; there are text and vcf")
    if output_formatter == "text" and quarantine_table is None:
        text = through(lines, cmd, env or {}, head).select(F.col("value").alias("text"))
        return text if not out_ignore_header else _without_first(lines, cmd, env or {}, head)
    folder = shared_folder(df.sparkSession)
    spool = f"{folder}-input" if quarantine_table is not None else None
    if spool:
        lines = _beside(df, lines.columns[0], input_formatter)
    try:
        through(lines, cmd, env or {}, head, spool).write.parquet(folder)
    except Exception:
        failed = quarantined(spool, df) if spool else None
        if failed is not None:
            flat = failed.select([F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns]) if quarantine_flavor == "csv" else failed
            flat.write.format(quarantine_flavor).mode("append").save(quarantine_table)
        raise
    _held.append(folder)
    held = df.sparkSession.read.schema("value string").parquet(folder)
    if output_formatter == "text":
        return held.select(F.col("value").alias("text"))
    header_rows = held.where(F.startswith("value", F.lit("#"))).distinct().collect()
    head_lines = [r["value"] for r in header_rows]
    columns = {x for x in head_lines if x.startswith("#CHROM")}
    if len(columns) > 1:
        raise ValueError("Cannot infer one schema: partitions have different headers")
    header = H.parse(sorted(x for x in head_lines if x.startswith("##")) + list(columns))
    return vcf_rows(held, header, H.schema(header, True, True), True, False)


def _beside(df: DataFrame, name: str, formatter: str) -> DataFrame:
    """The input lines with the rows that they come from."""
    if formatter == "text":
        return df.select(F.col(df.columns[0]).cast("string").alias("__value"), "*")
    return vcf_lines(df, beside=True)


def _without_first(lines: DataFrame, cmd: list[str], env: dict[str, str], head: list[str]) -> DataFrame:
    """The output without the first line of each partition's run."""

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = False
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0 if seen else 1)], names=["text"])
                seen = True

    return through(lines, cmd, env, head).mapInArrow(skip, "text string")


def pipe_cleanup(df: DataFrame | None = None) -> DataFrame | None:
    """Removes the tables that pipe() keeps."""
    while _held:
        fs, root = pafs.FileSystem.from_uri(_held.pop())
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)
    return df
