"""Statistics per sample over all variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from helixframe.functions.columns import divided
from helixframe.functions.genotypes import field_sums, variant_type
from helixframe.stats.kernels import NO_LEAST, NO_MOST, SAMPLE_COUNTS, SAMPLE_SUMS, Made, lengths, place_counts, place_sums, slices, struct


def _per_sample(df: DataFrame, genotypes: str, by: list[str], extra: list[Column]) -> DataFrame:
    return df.select(*by, *extra, F.posexplode(genotypes).alias("pos", "g"))


def _has_ids(df: DataFrame, genotypes: str) -> bool:
    return "sampleId" in df.schema[genotypes].dataType.elementType.fieldNames()


def _gathered(per: DataFrame, by: list[str], ids: bool, fields: list[str], name: str) -> DataFrame:
    """One row per group with the samples' structs in the order of their places."""
    names = (["sampleId"] if ids else []) + fields
    entry = F.struct("pos", F.struct(*names).alias("stats"))
    gathered = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["stats"]).alias(name)
    return per.groupBy(*by).agg(gathered) if by else per.agg(gathered)


#: Groups whose counts a task holds at once.
HELD_GROUPS = 64


def _added_up(rows: DataFrame, by: list[str], ids: bool, given: int, made: Made | None, counters: tuple, empty: list[int], ways: list, count: Callable) -> DataFrame:
    """A row for each group, place and task: by, pos, [sampleId] and counters.

    rows: by, other arguments of count, [labels], and the genotypes or, last, what they are made of. Each task adds up the counters of
    the samples over its batches, so the shuffle has as many rows as samples for each task.
    """
    names = [*by, "pos", *(["sampleId"] if ids else []), *counters]
    schema = StructType([*rows.schema.fields[: len(by)], StructField("pos", IntegerType()), *([StructField("sampleId", StringType())] if ids else []), *[StructField(c, LongType()) for c in counters]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        start = np.array(empty, np.int64).reshape(-1, 1)

        def emptied() -> Iterator[pa.RecordBatch]:
            for key, (counts, labels) in held.items():
                n = counts.shape[1]
                columns = [pa.array([k] * n, t) for k, t in zip(key, kinds)] + [pa.array(np.arange(n), pa.int32())]
                columns += [pa.array(labels, pa.string())] if ids else []
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in counts]], names=names)
            held.clear()

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in range(len(by))]
            for part, genotypes in slices(batch, made):
                keys = list(zip(*[part.column(c).to_pylist() for c in range(len(by))])) if by else [()] * part.num_rows
                for key in dict.fromkeys(keys):
                    own = pa.array([k == key for k in keys])
                    mine, values = (part, genotypes) if own.true_count == len(keys) else (part.filter(own), genotypes.filter(own))
                    added = count(values, *mine.columns[len(by) : len(by) + given])
                    n = added.shape[1]
                    if key not in held and len(held) >= HELD_GROUPS:
                        yield from emptied()
                    before, said = held.get(key, (np.repeat(start, n, 1), []))
                    if n > before.shape[1]:
                        before = np.concatenate([before, np.repeat(start, n - before.shape[1], 1)], 1)
                    for way, a, b in zip(ways, before, added):
                        way(a[:n], b, out=a[:n])
                    if ids:
                        sizes = lengths(mine.column(len(by) + given))
                        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        said = least_labels(mine.column(len(by) + given).flatten(), place, n, said)
                    held[key] = (before, said)
        yield from emptied()

    return rows.mapInArrow(run, schema)


def sample_call_stats_rows(df: DataFrame, genotypes: str = "genotypes", ref: str = "referenceAllele", alts: str = "alternateAlleles", by: list[str] | None = None, *, calls: Made | None = None) -> DataFrame:
    """One row per group and sample: pos, [sampleId], callRate, nCalled .. rHetHomVar.

    calls, made where they are counted, may stand for the genotypes; they bring no sampleId.
    """
    by, ids = by or [], calls is None and _has_ids(df, genotypes)
    types = F.transform(F.col(alts), lambda a: variant_type(F.col(ref), a))
    labels = [F.col(f"{genotypes}.sampleId").alias("__ids")] if ids else []
    source = [F.col(f"{genotypes}.calls").alias("__calls")] if calls is None else [c.alias(f"__of{i}") for i, c in enumerate(calls.columns)]
    rows = df.select(*by, types.alias("__types"), *labels, *source)
    each = _added_up(rows, by, ids, 1, calls, SAMPLE_COUNTS, [0] * len(SAMPLE_COUNTS), [np.add] * len(SAMPLE_COUNTS), place_counts)
    least = [F.min("sampleId").alias("sampleId")] if ids else []
    per = each.groupBy(*by, "pos").agg(*least, *[F.sum(c).alias(c) for c in SAMPLE_COUNTS])
    ratio = lambda a, b: divided(F.col(a), F.col(b))
    return per.select(
        *by, "pos", *(["sampleId"] if ids else []), divided(F.col("nCalled"), F.col("nCalled") + F.col("nUncalled")).alias("callRate"), "nCalled", "nUncalled", "nHomRef", "nHet", "nHomVar",
        (F.col("nTransition") + F.col("nTransversion")).alias("nSnp"), "nInsertion", "nDeletion", "nTransition", "nTransversion", "nSpanningDeletion",
        ratio("nTransition", "nTransversion").alias("rTiTv"), ratio("nInsertion", "nDeletion").alias("rInsertionDeletion"), ratio("nHet", "nHomVar").alias("rHetHomVar"),
    )


def least_labels(labels: pa.Array, place: np.ndarray, n: int, before: list) -> list:
    """The least label seen at each place; where all rows agree, as they mostly do, that is one comparison."""
    first = np.full(n, -1)
    first[place[::-1]] = np.arange(len(place))[::-1]
    lead = labels.take(pa.array(first))
    if pa.compute.all(pa.compute.equal(labels, lead.take(pa.array(place)))).as_py():
        now = lead.to_pylist()
    else:
        table = pa.table({"p": place, "x": labels}).group_by("p").aggregate([("x", "min")]).sort_by("p")
        now = table["x_min"].to_pylist()
    both = [now, before] if len(now) >= len(before) else [before, now]
    return [min((x for x in (a, b) if x is not None), default=None) for a, b in zip(both[0], both[1] + [None] * (len(both[0]) - len(both[1])))]


CALL_FIELDS = ["callRate", "nCalled", "nUncalled", "nHomRef", "nHet", "nHomVar", "nSnp", "nInsertion", "nDeletion", "nTransition", "nTransversion", "nSpanningDeletion", "rTiTv", "rInsertionDeletion", "rHetHomVar"]


def sample_call_summary_stats(df: DataFrame, genotypes: str = "genotypes", ref: str = "referenceAllele", alts: str = "alternateAlleles", by: list[str] | None = None) -> DataFrame:
    """Per group one row with sample_call_summary_stats, an array with one struct for each sample."""
    return _gathered(sample_call_stats_rows(df, genotypes, ref, alts, by), by or [], _has_ids(df, genotypes), CALL_FIELDS, "sample_call_summary_stats")


def sample_field_stats_rows(df: DataFrame, field: str, genotypes: str = "genotypes", by: list[str] | None = None, *, values: Made | None = None) -> DataFrame:
    """One row per group and sample: pos, [sampleId], mean, stdDev, min, max of a genotype field.

    values, arrays of int made where they are added up, may stand for the field; they bring no sampleId, and each task has a row for each sample.
    """
    by = by or []
    if values is not None:
        rows = df.select(*by, *[c.alias(f"__of{i}") for i, c in enumerate(values.columns)])
        ways = [np.add, np.add, np.add, np.add, np.minimum, np.maximum]
        each = _added_up(rows, by, False, 0, values, SAMPLE_SUMS, [0, 0, 0, 0, NO_LEAST, NO_MOST], ways, place_sums)
        per = each.groupBy(*by, "pos").agg(*[F.sum(c).alias(c) for c in SAMPLE_SUMS[:4]], F.min("min").alias("min"), F.max("max").alias("max"))
        n, total = F.col("n"), F.col("total")
        squares = (F.col("high").cast("decimal(18,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")).cast("decimal(28,0)")
        count, whole = n.cast("double"), n.cast("decimal(10,0)") * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
        deviation = F.when(n == 1, F.lit(float("nan"))).when(n > 1, F.sqrt(whole.cast("double") / count / (count - 1)))
        some = lambda c: F.when(n > 0, F.col(c).cast("double")).alias(c)
        return per.select(*by, "pos", F.when(n > 0, total.cast("double") / count).alias("mean"), deviation.alias("stdDev"), some("min"), some("max"))
    value = F.col(f"g.{field}").cast("double")
    ids = [F.min("g.sampleId").alias("sampleId")] if _has_ids(df, genotypes) else []
    deviation = F.when(F.count(value) == 1, F.lit(float("nan"))).otherwise(F.stddev_samp(value))
    return _per_sample(df, genotypes, by, []).groupBy(*by, "pos").agg(*ids, F.avg(value).alias("mean"), deviation.alias("stdDev"), F.min(value).alias("min"), F.max(value).alias("max"))


def sample_dp_summary_stats(df: DataFrame, genotypes: str = "genotypes", by: list[str] | None = None) -> DataFrame:
    return _gathered(sample_field_stats_rows(df, "depth", genotypes, by), by or [], _has_ids(df, genotypes), ["mean", "stdDev", "min", "max"], "sample_dp_summary_stats")


def sample_gq_summary_stats(df: DataFrame, genotypes: str = "genotypes", by: list[str] | None = None) -> DataFrame:
    return _gathered(sample_field_stats_rows(df, "conditionalQuality", genotypes, by), by or [], _has_ids(df, genotypes), ["mean", "stdDev", "min", "max"], "sample_gq_summary_stats")


#: What tells variants apart.
SITE_COLUMNS = ["contigName", "start", "end", "referenceAllele", "alternateAlleles"]


def merge_variants(frames: list[DataFrame], genotypes: str = "genotypes", sums: dict[str, str] | None = None) -> DataFrame:
    """Cohorts merged by site: genotypes put together and sorted, named columns summed."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    added = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return whole.groupBy(*SITE_COLUMNS).agg(*added, F.sort_array(F.flatten(F.collect_list(genotypes))).alias(genotypes))


#: Genotypes that are merged at a time where their totals alone are kept.
MERGED = 1 << 20


def merge_made(cohorts: list[tuple[DataFrame, list[str], Made]], field: str, tasks: int, totals: bool = False) -> DataFrame:
    """merge_variants of cohorts (rows, names of the samples, how their values are made) of whose genotypes one field of int is in use.

    Only sites are shuffled, to so many tasks; genotypes are made where they are merged. Where each sample's place in the merged order is
    told by its name, as for all rows of the same cohorts, that order is found once; values of samples of one name are sorted, nulls first.
    With totals, rows have field_totals t of the merged genotypes instead of these, of some rows at a time, so a task may merge as many as it likes.
    """
    whole = None
    for i, (df, _, made) in enumerate(cohorts):
        part = df.select(*SITE_COLUMNS, F.struct(F.lit(i).alias("cohort"), *[c.alias(f"of{k}") for k, c in enumerate(made.columns)]).alias("__of"))
        whole = part if whole is None else whole.unionByName(part)
    rows = whole.repartition(tasks, *SITE_COLUMNS).groupBy(*SITE_COLUMNS).agg(F.collect_list("__of").alias("__of"))
    merged = merger([names for _, names, _ in cohorts], [made for *_, made in cohorts], field)
    if totals:
        most = max(1, MERGED // max(1, sum(len(names) for _, names, _ in cohorts)))

        def merged_totals(column: pa.Array) -> pa.Array:
            parts = []
            for at in range(0, len(column), most):
                x = merged(column.slice(at, most))
                parts.append(struct({"n": pa.array(lengths(x)), "total": pa.array(field_sums(x, field))}))
            return pa.concat_arrays(parts)

        return rows.select(*SITE_COLUMNS, F.arrow_udf(merged_totals, "n long, total long")("__of").alias("t"))
    merge = F.arrow_udf(merged, f"array<struct<sampleId: string, {field}: int>>")
    return rows.select(*SITE_COLUMNS, merge("__of").alias("genotypes"))


def merger(names: list[list[str]], made: list[Made], field: str) -> Callable[[pa.Array], pa.Array]:
    """A kernel from lists of (cohort, what its values are made of) to genotypes (sampleId, field), sorted."""

    def placed(cohorts: tuple) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
        """The order of the samples of these cohorts, their names in it, and places of equal names: an array of them for each count."""
        said = pa.array([x for c in cohorts for x in names[c]], pa.string())
        order = pa.compute.sort_indices(said).to_numpy()
        said = said.take(pa.array(order))
        first = np.flatnonzero(np.concatenate([[True], pa.compute.not_equal(said[1:], said[:-1]).to_numpy(zero_copy_only=False)])) if len(said) else np.zeros(0, int)
        sizes = np.diff(np.append(first, len(said)))
        return order, said, [first[sizes == k].reshape(-1, 1) + np.arange(k) for k in np.unique(sizes[sizes > 1])]

    known: dict[tuple, tuple] = {}

    def merge(column: pa.Array) -> pa.Array:
        sizes, flat = lengths(column), column.flatten()
        cohort = pa.compute.struct_field(flat, "cohort").to_numpy()
        values, at = {}, np.zeros(len(flat), np.int64)
        for c in np.unique(cohort).tolist():
            own = flat.filter(pa.array(cohort == c))
            args = [pa.compute.struct_field(own, f"of{k}") for k in range(len(made[c].columns))]
            x = made[c].kernel(*args).flatten()
            # nulls are below all values of int
            values[c] = pa.compute.fill_null(x.cast(pa.int64()), NONE).to_numpy(zero_copy_only=False).reshape(len(own), len(names[c]))
            at[cohort == c] = np.arange(len(own))
        ends = np.cumsum(sizes)
        kinds: dict[tuple, list[int]] = {}
        for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
            kinds.setdefault(tuple(sorted(cohort[end - n : end].tolist())), []).append(i)
        parts, rows = [], []
        for cohorts, own in kinds.items():
            if cohorts not in known:
                known[cohorts] = placed(cohorts)
            order, said, ties = known[cohorts]
            width, entries = len(cohorts), np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in own]).reshape(len(own), -1)
            entries = np.take_along_axis(entries, np.argsort(cohort[entries], axis=1, kind="stable"), 1)
            x = np.concatenate([values[cohorts[k]][at[entries[:, k]]] for k in range(width)], axis=1)[:, order]
            for places in ties:
                if places.shape[1] == 2:
                    one, two = np.take(x, places[:, 0], 1), np.take(x, places[:, 1], 1)
                    x[:, places[:, 0]], x[:, places[:, 1]] = np.minimum(one, two), np.maximum(one, two)
                else:
                    x[:, places] = np.sort(x[:, places], axis=2)
            gone = x.reshape(-1) == NONE
            held = pa.array(np.where(gone, 0, x.reshape(-1)).astype(np.int32), mask=gone)
            labels = said.take(pa.array(np.tile(np.arange(len(said)), len(own))))
            offsets = pa.array((np.arange(len(own) + 1) * len(said)).astype(np.int32))
            parts.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([labels, held], names=["sampleId", field])))
            rows += own
        if len(parts) == 1:
            return parts[0]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(rows))) if parts else pa.array([], pa.list_(pa.struct([("sampleId", pa.string()), (field, pa.int32())])))

    return merge


#: Below all values of an int: what stands for null while values are sorted.
NONE = -(1 << 40)
