"""Functions of genotype arrays: array<struct<calls array<int>, ..>>, one element per sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.arrays import array_summary_stats
from helixframe.functions.columns import ColumnOrName, col, let
from helixframe.stats import kernels
from helixframe.stats.kernels import Made

CALL_STATS = "callRate double, nCalled int, nUncalled int, nHet int, nHomozygous array<int>, nNonRef int, nAllelesCalled int, alleleCounts array<int>, alleleFrequencies array<double>"
HARDY_WEINBERG = "hetFreqHwe double, pValueHwe double"


def call_stats_of(genotypes: pa.Array) -> pa.Array:
    return kernels.call_summary_stats(genotypes)


def hardy_weinberg_of(genotypes: pa.Array) -> pa.Array:
    return kernels.hardy_weinberg(genotypes)


def states_of(genotypes: pa.Array) -> pa.Array:
    return kernels.states(genotypes)


def field_stats_of(name: str):
    """A kernel for genotypes as SQL passes them, with all their fields."""

    def run(genotypes: pa.Array) -> pa.Array:
        field = pc.struct_field(genotypes.flatten(), name)
        offsets = np.concatenate([[0], np.cumsum(kernels.lengths(genotypes))]).astype(np.int32)
        return kernels.array_summary_stats(pa.ListArray.from_arrays(pa.array(offsets), field))

    return run


def _calls(genotypes: ColumnOrName | None, calls: ColumnOrName | None) -> Column:
    """The calls alone, so that no other field of the genotypes leaves the JVM; or the column of calls that is given in their place."""
    return col(genotypes)["calls"] if calls is None else col(calls)


def _on_calls(f, kind: str, genotypes: ColumnOrName | None, calls: ColumnOrName | None = None) -> Column:
    return F.arrow_udf(f, kind)(_calls(genotypes, calls))


def call_summary_stats(genotypes: ColumnOrName | None = None, *, calls: ColumnOrName | None = None) -> Column:
    """struct(callRate, nCalled, nUncalled, nHet, nHomozygous, nNonRef, nAllelesCalled, alleleCounts, alleleFrequencies).

    A genotype with any missing call is uncalled; its known alleles still count as alleles. Here and in hardy_weinberg,
    genotype_states and dosages, calls (array<array<int>>) may stand for the genotypes: another kernel's result then needs no way through the JVM.
    So may packed calls (binary: two signed bytes for each genotype), which pass through it as one value of a row.
    """
    return _on_calls(call_stats_of, CALL_STATS, genotypes, calls)


def dp_summary_stats(genotypes: ColumnOrName | None = None, *, depths: ColumnOrName | None = None) -> Column:
    return array_summary_stats(col(genotypes)["depth"] if depths is None else col(depths))


def gq_summary_stats(genotypes: ColumnOrName | None = None, *, qualities: ColumnOrName | None = None) -> Column:
    return array_summary_stats(col(genotypes)["conditionalQuality"] if qualities is None else col(qualities))


def field_sums(genotypes: pa.Array, field: str) -> np.ndarray:
    n, x = kernels.lengths(genotypes), pc.fill_null(pc.struct_field(genotypes.flatten(), field), 0).to_numpy(zero_copy_only=False)
    if len(n) and n[0] and (n == n[0]).all():
        return x.reshape(len(n), -1).sum(1, dtype=np.int64)
    return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])])


def field_totals(genotypes: ColumnOrName, field: str) -> Column:
    """struct(n, total): the count of genotypes, and the sum of a field of integers, nulls left out. A kernel's genotypes need no way through the JVM."""

    def totals_of(column: pa.Array) -> pa.Array:
        return kernels.struct({"n": pa.array(kernels.lengths(column)), "total": pa.array(field_sums(column, field))}, kernels.nulls_of(column))

    return F.arrow_udf(totals_of, "n long, total long")(col(genotypes))


def call_totals(calls: Made) -> Column:
    """struct(n, total, products): genotypes, the sum of their calls, and that of the products of the two calls where both are known; of diploid calls made where they are added up."""

    def totals_of(*columns: pa.Array) -> pa.Array:
        parts = [kernels.call_totals(x) for _, x in kernels.slices(kernels.batch_of(columns), calls)]
        return kernels.joined(parts, kernels.CALL_TOTALS)

    return F.arrow_udf(totals_of, "n long, total long, products long").asNondeterministic()(*calls.columns)


def call_sums_of(calls: pa.Array) -> pa.Array:
    return kernels.call_sums(calls)


def call_sums(calls: ColumnOrName) -> Column:
    """struct(first, second, placed) of packed calls: the sums of first and of second calls, and of first calls times their places from 1."""
    return F.arrow_udf(call_sums_of, "first long, second long, placed long")(col(calls))


def first_call_totals(genotypes: Made, field: str) -> Column:
    """struct(n, first, total): genotypes, the sum of their first calls, and that of a field of integers, both without nulls; of genotypes made where they are added up."""

    def totals_of(*columns: pa.Array) -> pa.Array:
        parts = []
        for _, x in kernels.slices(kernels.batch_of(columns), genotypes):
            each = kernels.diploid(x)
            first = each[:, :, 0].sum(1, dtype=np.int64) if each is not None else [sum(g["calls"][0] or 0 for g in row or [] if g and g["calls"]) for row in x.to_pylist()]
            parts.append(kernels.struct({"n": pa.array(kernels.lengths(x)), "first": pa.array(first, pa.int64()), "total": pa.array(field_sums(x, field))}))
        return kernels.joined(parts, pa.struct([(c, pa.int64()) for c in ("n", "first", "total")]))

    return F.arrow_udf(totals_of, "n long, first long, total long").asNondeterministic()(*genotypes.columns)


def hardy_weinberg(genotypes: ColumnOrName | None = None, *, calls: ColumnOrName | None = None) -> Column:
    """struct(hetFreqHwe, pValueHwe): the expected share of heterozygotes, and the exact mid-p value of a two-sided test.

    Given the counts of alleles, each possible count of heterozygotes has a probability (Levene and
    Haldane); less likely ones than the observed count in full.
    """
    return _on_calls(hardy_weinberg_of, HARDY_WEINBERG, genotypes, calls)


def genotype_states(genotypes: ColumnOrName | None = None, *, calls: ColumnOrName | None = None) -> Column:
    """Per sample the sum of its calls, or -1 if it has none or any is missing."""
    return _on_calls(states_of, "array<int>", genotypes, calls)


def dosages_of(genotypes: pa.Array) -> pa.Array:
    return kernels.dosages(genotypes)


def dosages(genotypes: ColumnOrName | None = None, *, calls: ColumnOrName | None = None) -> Column:
    """struct(values, varies): mean_substitute(genotype_states(..)) in one pass, and whether the values differ between samples.

    Filters on `varies` stay above the pass, so that the calls are sent to Python once.
    """
    return F.arrow_udf(dosages_of, "values array<double>, varies boolean").asNondeterministic()(_calls(genotypes, calls))


def _first_maximum(probabilities: Column, threshold: float) -> Column:
    """Place (from 0) of the first largest probability of at least the threshold and over 0; null if none."""
    able = F.transform(probabilities, lambda p: F.when((p >= threshold) & (p > 0), p))
    best = F.array_max(able)
    return let(F.struct(able.alias("a"), best.alias("b")), lambda s: F.when(s["b"].isNotNull(), F.array_position(s["a"], s["b"]).cast("int") - 1))


def hard_calls(probabilities: ColumnOrName, num_alts: ColumnOrName, phased: ColumnOrName, threshold: float = 0.9) -> Column:
    """Diploid calls from genotype probabilities; [-1, -1] parts where none reaches the threshold.

    Unphased probabilities are in the order 00, 01, 11, 02, 12, 22 ..; phased ones list each
    haplotype's alleles. A null argument gives null.
    """
    p, alts, is_phased = col(probabilities).cast("array<double>"), col(num_alts).cast("int"), col(phased)
    haplotype = lambda i: F.coalesce(_first_maximum(F.slice(p, i * (alts + 1) + 1, alts + 1), threshold), F.lit(-1))

    def pair(at: Column) -> Column:
        high = F.floor((F.sqrt(8.0 * at + 1) - 1) / 2).cast("int")
        return F.when(at.isNull(), F.array(F.lit(-1), F.lit(-1))).otherwise(let(high, lambda k: F.array((at - F.floor(k * (k + 1) / 2)).cast("int"), k)))

    calls = F.when(is_phased, F.array(haplotype(F.lit(0)), haplotype(F.lit(1)))).otherwise(let(_first_maximum(p, threshold), pair))
    return F.when(p.isNotNull() & alts.isNotNull() & is_phased.isNotNull(), calls)


def variant_type(ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """Transition, Transversion, SpanningDeletion, Insertion, Deletion or Unknown."""
    r, a = col(ref), col(alt)
    pairs = F.filter(F.zip_with(F.split(r, ""), F.split(a, ""), lambda x, y: F.when(~x.eqNullSafe(y), F.concat(x, y))), lambda x: x.isNotNull())
    change = F.when((F.length(r) == F.length(a)) & (F.size(pairs) == 1), F.get(pairs, F.lit(0)))
    same_head = F.substring(r, 1, 1) == F.substring(a, 1, 1)
    tail = lambda x: F.substr(x, F.lit(2))
    return (
        F.when(change.isin("AG", "GA", "CT", "TC"), "Transition")
        .when(change.isin("AC", "CA", "AT", "TA", "CG", "GC", "GT", "TG"), "Transversion")
        .when(a == "*", "SpanningDeletion")
        .when((F.length(r) < F.length(a)) & (F.length(a) >= 2) & same_head & F.endswith(a, tail(r)), "Insertion")
        .when((F.length(r) > F.length(a)) & (F.length(r) >= 2) & same_head & F.endswith(r, tail(a)), "Deletion")
        .otherwise("Unknown")
    )
