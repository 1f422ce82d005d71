"""Functions of variants' coordinates and alleles that need reference files, on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from helixframe.functions.columns import ColumnOrName, col
from helixframe.genome.chain import LiftOver
from helixframe.genome.fasta import Fasta
from helixframe.genome.normalize import normalize

LIFTED = StructType().add("contigName", StringType()).add("start", LongType()).add("end", LongType())
STATUS = StructType().add("changed", BooleanType()).add("errorMessage", StringType())
NORMALIZED = StructType().add("start", LongType()).add("end", LongType()).add("referenceAllele", StringType()).add("alternateAlleles", ArrayType(StringType())).add("normalizationStatus", STATUS)


def lift_over_coordinates(contig: ColumnOrName, start: ColumnOrName, end: ColumnOrName, chain_file: str, min_match_ratio: float = 0.95) -> Column:
    """struct(contigName, start, end) on the other assembly; null if it does not map or an argument is null."""

    def run(c: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        chains = LiftOver.of(chain_file)
        found = [None if pd.isna(a) or pd.isna(b) or x is None else chains.lift(x, int(a), int(b), min_match_ratio) for x, a, b in zip(c, s, e)]
        rows = [(None, None, None) if f is None else (f.contig, f.start, f.end) for f in found]
        return pd.DataFrame(rows, columns=LIFTED.names).astype({"start": "Int64", "end": "Int64"})

    lifted = F.pandas_udf(run, LIFTED, F.PandasUDFType.SCALAR)(col(contig), col(start).cast("long"), col(end).cast("long"))
    return F.when(lifted["contigName"].isNotNull(), lifted)


def normalize_variant(contig: ColumnOrName, start: ColumnOrName, end: ColumnOrName, ref: ColumnOrName, alts: ColumnOrName, reference_genome: str) -> Column:
    """struct(start, end, referenceAllele, alternateAlleles, normalizationStatus(changed, errorMessage)); null if an argument but the alternate alleles is null."""

    def run(c: pd.Series, s: pd.Series, e: pd.Series, r: pd.Series, a: pd.Series) -> pd.DataFrame:
        fasta = Fasta.of(reference_genome)
        rows = []
        for values in zip(c, s, e, r, a):
            if values[0] is None or pd.isna(values[1]) or pd.isna(values[2]) or values[3] is None:
                rows.append((None, None, None, None, None))
                continue
            n = normalize(values[0], int(values[1]), int(values[2]), values[3], None if values[4] is None else list(values[4]), fasta)
            rows.append((n.start, n.end, n.ref, n.alts, {"changed": n.changed, "errorMessage": n.error}))
        return pd.DataFrame(rows, columns=NORMALIZED.names).astype({"start": "Int64", "end": "Int64"})

    done = F.pandas_udf(run, NORMALIZED, F.PandasUDFType.SCALAR)(col(contig), col(start).cast("long"), col(end).cast("long"), col(ref), col(alts))
    return F.when(done["normalizationStatus"].isNotNull(), done)
