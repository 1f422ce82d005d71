"""Reading GFF3 and GTF annotations as a projection of text lines."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed columns of a GFF line, and the official attribute tags with their types, in the order of columns.
FIELDS = {"seqId": "string", "source": "string", "type": "string", "start": "long", "end": "long", "score": "double", "strand": "string", "phase": "int", "attributes": "string"}
OFFICIAL = {
    "id": "string", "name": "string", "alias": "array<string>", "parent": "array<string>", "target": "string", "gap": "string", "derivesfrom": "string",
    "note": "array<string>", "dbxref": "array<string>", "ontologyterm": "array<string>", "iscircular": "boolean",
}


def read_gff(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Features with a column per attribute tag.

    Tags are matched without regard to case and underscores; official ones come first with their
    types, others follow by name as strings. start is made 0-based. Comments, lines
    that are not nine columns of the right types and sequences at the end are dropped, "." is null. A schema chooses columns and may keep attributes.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(parts) == len(FIELDS)))
    known = [F.when(~F.get(parts, F.lit(i)).isin(".", ""), F.get(parts, F.lit(i))) for i in range(len(FIELDS))]
    raw = lines.select(*[c.try_cast(kind).alias(name) for c, (name, kind) in zip(known, FIELDS.items())], *[(c.isNotNull() & c.try_cast(kind).isNull()).alias(f"__bad_{name}") for c, (name, kind) in zip(known, FIELDS.items()) if kind != "string"])
    bad = [c for c in raw.columns if c.startswith("__bad_")]
    raw = raw.where(~functools.reduce(operator.or_, map(F.col, bad))).drop(*bad)
    plain = lambda c: F.lower(F.regexp_replace(c, "_", ""))
    parts = F.filter(F.transform(F.split("attributes", ";"), lambda x: F.trim(x)), lambda x: x != "")
    gtf = lambda x: F.when(F.contains(x, F.lit("=")), F.split(x, "=", 2)).otherwise(F.split(F.regexp_replace(x, '"', ""), " ", 2))
    entries = F.transform(F.transform(parts, gtf), lambda p: F.struct(plain(F.trim(F.get(p, F.lit(0)))).alias("k"), F.trim(F.get(p, F.lit(1))).alias("v")))
    tagged = raw.withColumn("start", F.col("start") - 1).withColumn("__tags", entries)
    if schema is None:
        rows = tagged.select(F.explode(F.transform(F.split("attributes", ";"), lambda x: F.trim(F.regexp_extract(x, r"^\s*([^=\s]+)", 1)))).alias("tag")).where("tag <> ''").distinct()
        tags = [r["tag"] for r in rows.collect()]  # the distinct tags of the files
        names = {t.lower().replace("_", ""): t for t in sorted(tags, reverse=True)}
        fields = [(k, OFFICIAL[k]) for k in OFFICIAL if k in names] + [(names[k], "string") for k in sorted(names) if k not in OFFICIAL]
        base = [c for c in raw.columns if c != "attributes"]
    else:
        base = [f.name for f in schema if f.name in raw.columns]
        fields = [(f.name, f.dataType.simpleString()) for f in schema if f.name not in raw.columns]

    def tag(name: str, kind: str):
        found = F.get(F.filter("__tags", lambda e: e["k"] == name.lower().replace("_", "")), F.lit(0))["v"]
        value = F.when(found != "", found)
        return (F.split(value, ",") if kind.startswith("array") else value.cast(kind)).alias(name)

    out = tagged.select(*base, *[tag(n, k) for n, k in fields])
    return out.select(*[f.name for f in schema]) if schema is not None else out
