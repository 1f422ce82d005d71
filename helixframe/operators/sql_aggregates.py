"""Per-sample statistics and matrix rows as SQL names.

Table functions are the way for whole cohorts: each task adds up its own rows of the table argument and
gives one row for each sample, which SQL then sums, so that genotypes are not shuffled:

    SELECT pos, min(sampleId), sum(nCalled) FROM sample_call_counts(
      TABLE(SELECT genotypes, referenceAllele, alternateAlleles FROM cohort)) GROUP BY pos

The aggregates of the same statistics (sample_call_summary_stats, sample_dp_summary_stats,
sample_gq_summary_stats) give an array with one struct for each sample. Spark hands all genotypes of
a group to one task for them, so they are for groups that fit there.

Rows with null genotypes count for no sample, and a group without genotypes has no samples; the aggregates
give no row for an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.stats.kernels import SAMPLE_COUNTS, Made, lengths, place_counts, place_sums, slices

#: Fixed: changes of one base within purines or within pyrimidines.
TRANSITIONS = {"AG", "GA", "CT", "TC"}
COUNT_ROWS = "pos int, sampleId string, " + ", ".join(f"{c} long" for c in SAMPLE_COUNTS)
FIELD_ROWS = "pos int, sampleId string, n long, total double, squares double, min double, max double"
CALL_STRUCT = (
    "array<struct<sampleId:string,callRate:double,nCalled:bigint,nUncalled:bigint,nHomRef:bigint,nHet:bigint,nHomVar:bigint,nSnp:bigint,nInsertion:bigint,nDeletion:bigint,"
    "nTransition:bigint,nTransversion:bigint,nSpanningDeletion:bigint,rTiTv:double,rInsertionDeletion:double,rHetHomVar:double>>"
)
FIELD_STRUCT = "array<struct<sampleId:string,mean:double,stdDev:double,min:double,max:double>>"


def change(ref: str | None, alt: str | None) -> str:
    """The kind of a variant, as functions.variant_type tells it."""
    if ref is None or alt is None:
        return "Unknown"
    if len(ref) == len(alt):
        pairs = [x + y for x, y in zip(ref, alt) if x != y]
        if len(pairs) == 1 and set(pairs[0]) <= set("ACGT"):
            return "Transition" if pairs[0] in TRANSITIONS else "Transversion"
    if alt == "*":
        return "SpanningDeletion"
    short, long = sorted((ref, alt), key=len)
    if len(short) < len(long) and short and short[0] == long[0] and long.endswith(short[1:]):
        return "Insertion" if long is alt else "Deletion"
    return "Unknown"


def kinds_of(ref: pa.Array, alts: pa.Array) -> pa.Array:
    known: dict[tuple, str] = {}
    said = []
    for r, a in zip(ref.to_pylist(), alts.to_pylist()):
        said.append([known.setdefault((r, x), change(r, x)) for x in a or []])
    return pa.array(said, pa.list_(pa.string()))


class PerSample:
    """Counters by place among a row's samples, and the least label seen there."""

    def __init__(self, counters: int, empty: list[float], ways: list) -> None:
        self.counts, self.labels = np.zeros((counters, 0)) + np.array(empty).reshape(-1, 1), []
        self.empty, self.ways = empty, ways

    def add(self, values: np.ndarray) -> None:
        """values: a row of counters, by place."""
        if values.shape[1] > self.counts.shape[1]:
            more = values.shape[1] - self.counts.shape[1]
            self.counts = np.concatenate([self.counts, np.repeat(np.array(self.empty, float).reshape(-1, 1), more, 1)], 1)
            self.labels += [None] * more
        for own, way, v in zip(self.counts, self.ways, values):
            way(own[: len(v)], v, out=own[: len(v)])

    def label(self, place: np.ndarray, labels: pa.Array | None) -> None:
        if labels is not None and len(place):
            least = pa.table({"p": place, "x": labels}).group_by("p").aggregate([("x", "min")])
            for p, x in zip(least["p"].to_pylist(), least["x_min"].to_pylist()):
                if x is not None and (self.labels[p] is None or x < self.labels[p]):
                    self.labels[p] = x


def places(genotypes: pa.Array) -> np.ndarray:
    n = lengths(genotypes)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def labels_of(genotypes: pa.Array) -> pa.Array | None:
    inner = genotypes.flatten()
    return pc.struct_field(inner, "sampleId") if pa.types.is_struct(inner.type) and inner.type.get_field_index("sampleId") >= 0 else None


def call_counters() -> PerSample:
    return PerSample(len(SAMPLE_COUNTS), [0.0] * len(SAMPLE_COUNTS), [np.add] * len(SAMPLE_COUNTS))


def add_calls(held: PerSample, genotypes: pa.Array, ref: pa.Array, alts: pa.Array) -> None:
    held.add(place_counts(genotypes, kinds_of(ref, alts)))
    labels = labels_of(genotypes)
    if labels is not None:
        held.label(places(genotypes), labels)


def field_counters() -> PerSample:
    return PerSample(5, [0.0, 0.0, 0.0, np.inf, -np.inf], [np.add, np.add, np.add, np.minimum, np.maximum])


def add_field(held: PerSample, genotypes: pa.Array, field: str) -> None:
    if not pa.types.is_struct(genotypes.type.value_type):
        n, total, high, low, least, largest = place_sums(genotypes)
        none = n == 0
        held.add(np.stack([n, total, high * 2.0**32 + low, np.where(none, np.inf, least), np.where(none, -np.inf, largest)]))
        return
    place, width = places(genotypes), int(lengths(genotypes).max(initial=0))
    x = pc.struct_field(genotypes.flatten(), field).cast(pa.float64())
    known = x.is_valid().to_numpy(zero_copy_only=False)
    v = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
    values = [known.astype(float), v * known, v * v * known, np.where(known, v, np.inf), np.where(known, v, -np.inf)]
    added = np.repeat(np.array(held.empty, float).reshape(-1, 1), width, 1)
    for own, way, each in zip(added, held.ways, values):
        if way is np.add:
            own += np.bincount(place, each, width)
        else:
            way.at(own, place, each)
    held.add(added)
    held.label(place, labels_of(genotypes))


def counted(held: PerSample) -> pa.Table:
    n = held.counts.shape[1]
    columns = {"pos": pa.array(np.arange(n), pa.int32()), "sampleId": pa.array(held.labels, pa.string())}
    return pa.table({**columns, **{c: pa.array(v.astype(np.int64)) for c, v in zip(SAMPLE_COUNTS, held.counts)}})


def summed(held: PerSample) -> pa.Table:
    n, total, squares, low, high = held.counts
    none = n == 0
    columns = {"pos": pa.array(np.arange(len(n)), pa.int32()), "sampleId": pa.array(held.labels, pa.string()), "n": pa.array(n.astype(np.int64)), "total": pa.array(total), "squares": pa.array(squares)}
    return pa.table({**columns, "min": pa.array(low, mask=none), "max": pa.array(high, mask=none)})


class SampleCallCounts:
    """Table function: counts of calls and of kinds of alleles for each sample, of the rows that a task has."""

    def __init__(self) -> None:
        self.held = call_counters()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        add_calls(self.held, *(rows.column(c) for c in ("genotypes", "referenceAllele", "alternateAlleles")))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        yield counted(self.held)


class _FieldSums:
    field = ""

    def __init__(self) -> None:
        self.held = field_counters()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        add_field(self.held, rows.column("genotypes"), self.field)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        yield summed(self.held)


class SampleDepthSums(_FieldSums):
    """Table function: count, sum, sum of squares, least and largest depth for each sample, of the rows that a task has."""

    field = "depth"


class SampleQualitySums(_FieldSums):
    """The same of conditionalQuality."""

    field = "conditionalQuality"


def of_made(kind: type, made: Made) -> type:
    """The table function over rows of which it makes the calls or the field's values itself, some rows at a time.

    Its arguments' columns are those of the table function besides genotypes, then what genotypes are made of; sampleId is null.
    """

    class OfMade(kind):
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            given = rows.num_columns - len(made.columns)
            for part, genotypes in slices(rows, made):
                names = ["genotypes", *rows.schema.names[:given]]
                super().eval(pa.RecordBatch.from_arrays([genotypes, *part.columns[:given]], names=names))
            return iter(())

    return OfMade


class MatrixRows:
    """Table function: the rows of a matrix; a null one has none."""

    def eval(self, matrix) -> Iterator[tuple]:
        if matrix is not None:
            for row in matrix.toArray().tolist():
                yield (row,)


def ratio(a: float, b: float) -> float:
    """a / b as doubles are divided: infinite or not a number where b is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.float64(a) / np.float64(b))


def sample_call_summary_stats(genotypes: pa.Array, ref: pa.Array, alts: pa.Array) -> list:
    held = call_counters()
    add_calls(held, genotypes, ref, alts)
    out = []
    for label, values in zip(held.labels, held.counts.T.astype(int).tolist()):
        c = dict(zip(SAMPLE_COUNTS, values))
        ratios = {"rTiTv": ("nTransition", "nTransversion"), "rInsertionDeletion": ("nInsertion", "nDeletion"), "rHetHomVar": ("nHet", "nHomVar")}
        more = {"sampleId": label, "callRate": ratio(c["nCalled"], c["nCalled"] + c["nUncalled"]), "nSnp": c["nTransition"] + c["nTransversion"]}
        out.append({**c, **more, **{k: ratio(c[a], c[b]) for k, (a, b) in ratios.items()}})
    return out


def field_summary(field: str):
    def run(genotypes: pa.Array) -> list:
        held = field_counters()
        add_field(held, genotypes, field)
        out = []
        for label, (n, total, squares, low, high) in zip(held.labels, held.counts.T.tolist()):
            mean = total / n if n else None
            deviation = None if n == 0 else float("nan") if n == 1 else max(0.0, (squares - total * total / n) / (n - 1)) ** 0.5
            out.append({"sampleId": label, "mean": mean, "stdDev": deviation, "min": low if n else None, "max": high if n else None})
        return out

    return run


TABLE_FUNCTIONS = {"sample_call_counts": (SampleCallCounts, COUNT_ROWS), "sample_dp_sums": (SampleDepthSums, FIELD_ROWS), "sample_gq_sums": (SampleQualitySums, FIELD_ROWS)}
AGGREGATES = {
    "sample_call_summary_stats": (sample_call_summary_stats, CALL_STRUCT),
    "sample_dp_summary_stats": (field_summary("depth"), FIELD_STRUCT),
    "sample_gq_summary_stats": (field_summary("conditionalQuality"), FIELD_STRUCT),
}


def register_aggregates(spark: SparkSession) -> None:
    for name, (kind, rows) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.arrow_udtf(kind, returnType=rows))
    spark.udtf.register("explode_matrix", F.udtf(MatrixRows, returnType="row array<double>"))
    for name, (f, kind) in AGGREGATES.items():
        spark.udf.register(name, F.arrow_udf(f, kind))
