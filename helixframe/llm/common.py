"""What the operators share: shared folders, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular expression class: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]"
#: Bytes of files that a task reads back.
READ_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where that setting is absent, a temporary folder takes its place if the session runs on this machine
    alone (tests); on a cluster that is an error, as executors would write where nobody else reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "://" not in base:
        base = base if base.startswith("file:") else "file://" + base
    return f"{base.rstrip('/')}/helixframe-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in a shared folder: cuts the lineage and survives the loss of executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_by_bytes(index: DataFrame, chunk: Column, read_bytes: int = READ_BYTES) -> DataFrame:
    """index (file, length, ..) with its chunk, dealt by file and chunk to as many tasks as its bytes ask for.

    The count is explicit, so adaptive execution does not pack chunks together by the bytes of the index;
    a small archive still occupies all cores.
    """
    spark = index.sparkSession
    chunked = index.withColumn("chunk", chunk)
    r = chunked.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.approx_count_distinct(F.struct("file", "chunk")).alias("chunks")).first()
    n = max(1, -(-r["bytes"] // read_bytes), min(r["chunks"], 2 * spark.sparkContext.defaultParallelism))
    return chunked.repartition(n, "file", "chunk")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its scan has fewer splits than half of them: small then, by the size of splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in have:
        k += 1
        name = f"__{stem}_{k}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c):
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
