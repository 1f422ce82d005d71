"""Lifting variants, coordinates and alleles, to another assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from helixframe.genome.chain import LiftOver
from helixframe.genome.fasta import Fasta, reverse_complement
from helixframe.genome.normalize import normalize

#: Fixed messages of rows that could not be lifted.
NO_TARGET, STRADDLES, CANNOT_REVERSE, MISMATCH = "NoTarget", "IndelStraddlesMultipleIntevals", "CannotLiftOver", "MismatchedRefAllele"
#: Of rows that lack a field of the variant, with the names of these.
INCOMPLETE, VARIANT = "IncompleteVariant", ("contigName", "start", "end", "referenceAllele", "alternateAlleles")
RESULT = StructType().add("contigName", StringType()).add("start", "long").add("end", "long").add("referenceAllele", StringType()).add("alternateAlleles", ArrayType(StringType())).add("reversed", BooleanType()).add("swapped", BooleanType()).add("error", StringType())


def _bases(a: str) -> bool:
    return set(a.upper()) <= set("ACGTN")


def lift_variant(contig: str | None, start: int | None, end: int | None, ref: str | None, alts: list[str] | None, chains: LiftOver, fasta: Fasta, ratio: float) -> tuple:
    """The fields of RESULT for one variant."""
    fail = lambda why: (None, None, None, None, None, False, False, why)
    missing = [name for name, x in zip(VARIANT, (contig, start, end, ref, alts)) if x is None or x is pd.NA or x != x]
    if missing:
        return fail(f"{INCOMPLETE}: {', '.join(missing)}")
    at = chains.lift(contig, int(start), int(end), ratio)
    if at is None or at.contig not in fasta:
        return fail(NO_TARGET)
    if at.end - at.start != end - start:
        return fail(STRADDLES)
    new_start, new_end = at.start, at.end
    if at.negative:
        if not all(_bases(a) for a in [ref, *alts]):
            return fail(CANNOT_REVERSE)
        ref, alts = reverse_complement(ref), [reverse_complement(a) for a in alts]
        if any(len(a) != 1 for a in [ref, *alts]):
            if fasta.bases(at.contig, new_start, new_end) != ref.upper():
                return fail(CANNOT_REVERSE)
            # what anchored the alleles on the left now does on the right
            n = normalize(at.contig, new_start, new_end, ref, alts, fasta)
            new_start, ref, alts = n.start, n.ref, n.alts
            new_end = new_start + len(ref)
    there = fasta.bases(at.contig, new_start, new_end)
    swapped = False
    if there != ref.upper():
        if len(alts) == 1 and len(ref) == 1 and len(alts[0]) == 1 and there == alts[0].upper():
            ref, alts, swapped = alts[0], [ref], True
        else:
            return fail(f"{MISMATCH}: {at.contig}:{new_start + 1}-{new_end}")
    return at.contig, new_start, new_end, ref, alts, at.negative, swapped, None


def lift_over_variants(df: DataFrame, chain_file: str, reference_file: str, min_match_ratio: float = 0.95) -> DataFrame:
    """df on the other assembly, with INFO_SwappedAlleles, INFO_ReverseComplementedAlleles and liftOverStatus.

    Where reference and alternate allele change places, calls 0 and 1 do too, allele frequency INFO
    becomes its complement, arrays of genotypes and INFO are reversed, and a highest frequency is
    dropped. Rows that fail, or lack a field of the variant, keep their values and say why.
    """

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        chains, fasta = LiftOver.of(chain_file), Fasta.of(reference_file)
        for c, s, e, r, a in parts:
            rows = [lift_variant(*v[:4], None if v[4] is None else list(v[4]), chains, fasta, min_match_ratio) for v in zip(c, s, e, r, a)]
            yield pd.DataFrame(rows, columns=RESULT.names).astype({"start": "Int64", "end": "Int64"})

    lift = F.pandas_udf(run, RESULT, F.PandasUDFType.SCALAR_ITER)
    out = df.withColumn("__lift", lift("contigName", "start", "end", "referenceAllele", "alternateAlleles"))
    x = F.col("__lift")
    ok, swapped = x["error"].isNull(), F.col("__lift.swapped")
    new = {c: F.when(ok, x[c]).otherwise(F.col(c)) for c in ("contigName", "start", "end", "referenceAllele", "alternateAlleles")}
    for f in df.schema:
        if f.name == "INFO_AF":
            flipped = F.transform(f.name, lambda v: 1 - v) if isinstance(f.dataType, ArrayType) else 1 - F.col(f.name)
            new[f.name] = F.when(swapped, flipped).otherwise(F.col(f.name))
        elif f.name == "INFO_MAX_AF":
            new[f.name] = F.when(~swapped, F.col(f.name))
        elif f.name.startswith("INFO_") and isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, StructType):
            new[f.name] = F.when(swapped, F.reverse(f.name)).otherwise(F.col(f.name))
    if "genotypes" in df.columns:
        kind = df.schema["genotypes"].dataType.elementType

        def field(g, f):
            if f.name == "calls":
                return F.transform(g["calls"], lambda c: F.when(c == 0, 1).when(c == 1, 0).otherwise(c))
            return F.reverse(g[f.name]) if isinstance(f.dataType, ArrayType) else g[f.name]

        other = F.transform("genotypes", lambda g: F.struct(*[field(g, f).alias(f.name) for f in kind]))
        new["genotypes"] = F.when(swapped, other).otherwise(F.col("genotypes"))
    new["INFO_SwappedAlleles"] = F.coalesce(swapped, F.lit(False))
    new["INFO_ReverseComplementedAlleles"] = F.coalesce(F.col("__lift.reversed"), F.lit(False))
    new["liftOverStatus"] = F.struct(ok.alias("success"), x["error"].alias("errorMessage"))
    return out.withColumns(new).drop("__lift")
