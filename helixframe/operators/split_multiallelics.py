"""Splitting rows of several alternate alleles into biallelic ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Genotype fields in the colexicographic order of genotypes.
LIKELIHOODS = ("genotypeLikelihoods", "phredLikelihoods", "posteriorProbabilities")
#: Metadata key of an INFO field's count; "A" is one value per alternate allele.
COUNT_KEY = "vcf_header_count"


def splittable_info(schema: StructType) -> list[str]:
    return [f.name for f in schema if f.name.startswith("INFO_") and isinstance(f.dataType, ArrayType) and f.metadata.get(COUNT_KEY) == "A"]


def kept_likelihoods(ploidy: Column, allele: Column) -> Column:
    """Places (from 0) of the genotypes of the reference and one alternate allele (from 1) only.

    With t copies of the allele the place is a sum of binomials, one per copy, each over the one
    before by a factor; for two copies these are 0, a(a+1)/2 and a(a+1)/2 + a.
    """
    p, a = ploidy.cast("long"), allele.cast("long")
    rise = lambda n: F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(1).cast("long"), lambda s, i: F.call_function("div", s * (a - 1 + i), i))
    # the t largest slots hold the allele: slot i of them adds comb(allele - 1 + i, i)
    slots = F.transform(F.sequence(F.lit(0).cast("long"), p), lambda t: F.when(t == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(p - t + 1, p), F.lit(0).cast("long"), lambda s, i: s + rise(i))))
    diploid = F.array(F.lit(0).cast("long"), F.floor(a * (a + 1) / 2), F.floor(a * (a + 1) / 2) + a)
    return F.when(p == 2, diploid).otherwise(slots)


def split_packed(calls: pa.Array, allele: pa.Array) -> pa.Array:
    """Packed calls of the reference and one alternate allele only, as 0 and 1; all calls where the allele is null."""
    out = []
    for x, a in zip(calls, allele.to_pylist()):
        if a is None or not x.is_valid:
            out.append(x.as_py())
            continue
        own = np.frombuffer(x.as_buffer(), np.int8)
        met = own == a
        out.append((met.view(np.int8) - (~met & (own != 0)).view(np.int8)).tobytes())
    return pa.array(out, pa.binary())


def split_multiallelics(df: DataFrame, split_info_fields: list[str] | None = None) -> DataFrame:
    """Rows with one alternate allele each; those that were split say so and keep the old alleles in INFO_OLD_MULTIALLELIC.

    Calls of other alternate alleles become missing. Likelihoods keep the genotypes of the two
    alleles, arrays with a value per allele keep two, other arrays of split rows become null.
    Rows without alternate alleles are dropped. Nothing is shuffled. A binary column calls, packed calls, may stand for the genotypes.
    """
    info = splittable_info(df.schema) if split_info_fields is None else split_info_fields
    many = F.size("alternateAlleles") > 1
    old = F.when(many, F.concat_ws(":", "contigName", (F.col("start") + 1).cast("string"), F.concat_ws("/", "referenceAllele", "alternateAlleles")))
    marked = df.withColumns({"splitFromMultiAllelic": F.coalesce(many, F.lit(False)), "INFO_OLD_MULTIALLELIC": old})
    each = marked.select("*", F.size("alternateAlleles").alias("__n_alts"), F.posexplode("alternateAlleles").alias("__alt", "__allele"))
    index, split = F.col("__alt"), F.col("splitFromMultiAllelic")
    n_alts = F.col("__n_alts")
    out = {name: F.when(split & (F.size(name) == n_alts), F.array(F.get(F.col(name), index))).otherwise(F.col(name)) for name in info}
    if "genotypes" in df.columns:
        kind = df.schema["genotypes"].dataType.elementType
        ploidy = F.size(F.get(F.col("genotypes.calls"), F.lit(0))) if "calls" in kind.fieldNames() else F.lit(2)
        if any(f.name in LIKELIHOODS for f in kind):
            each = each.withColumn("__places", F.when(split, kept_likelihoods(ploidy, index + 1)))

        def field(g: Column, name: str, data_type) -> Column:
            x = g[name]
            if name == "calls":
                return F.transform(x, lambda c: F.when(c == 0, 0).when(c == index + 1, 1).otherwise(-1))
            if name in LIKELIHOODS:
                return F.when(x.isNotNull(), F.filter(F.transform("__places", lambda i: F.get(x, i.cast("int"))), lambda v: v.isNotNull()))
            if isinstance(data_type, ArrayType):
                return F.when(F.size(x) == n_alts + 1, F.array(F.get(x, F.lit(0)), F.get(x, index + 1)))
            return x

        rebuilt = F.transform("genotypes", lambda g: F.struct(*[field(g, f.name, f.dataType).cast(f.dataType).alias(f.name) for f in kind]))
        out["genotypes"] = F.when(split, rebuilt).otherwise(F.col("genotypes"))
    if dict(df.dtypes).get("calls") == "binary":
        out["calls"] = F.arrow_udf(split_packed, "binary")("calls", F.when(split, index + 1))
    names = [c for c in each.columns if not c.startswith("__")]
    said = {**out, "alternateAlleles": F.array("__allele")}
    keep = lambda c: said[c].alias(c, metadata=df.schema[c].metadata) if c in df.columns else said[c].alias(c)
    return each.select(*[keep(c) if c in said else F.col(c) for c in names])
