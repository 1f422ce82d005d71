"""Normalizing the variants of a table against a reference genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.genome import normalize_variant
from helixframe.operators.split_multiallelics import split_multiallelics

FIELDS = ("start", "end", "referenceAllele", "alternateAlleles")


def normalize_variants(df: DataFrame, reference_genome_path: str | None = None, replace_columns: bool = True, mode: str = "normalize") -> DataFrame:
    """df with normalized coordinates and alleles and normalizationStatus, or with the column normalizationResult beside the old ones.

    The modes split and split_and_normalize split multiallelic rows, alone or first.
    """
    if mode not in ("normalize", "split", "split_and_normalize"):
        raise ValueError(f"Invalid mode {mode}")
    if mode != "normalize":
        df = split_multiallelics(df)
    if mode == "split":
        return df
    if not reference_genome_path:
        raise ValueError("reference_genome_path is required to normalize")
    out = df.withColumn("normalizationResult", normalize_variant("contigName", "start", "end", "referenceAllele", "alternateAlleles", reference_genome_path))
    if not replace_columns:
        return out
    result = F.col("normalizationResult")
    new = {c: F.when(result["normalizationStatus"]["changed"], result[c]).otherwise(F.col(c)) for c in FIELDS}
    return out.withColumns({**new, "normalizationStatus": result["normalizationStatus"]}).drop("normalizationResult")
