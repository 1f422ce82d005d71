"""Statistics of array columns, a batch of rows at a time, on the flat values that Arrow holds.

A column of arrays is one array of values and the length of each row, so each statistic is a few numpy
operations for all rows of a batch. Nested calls, array<array<int>>, are flat in the same way.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Probabilities within this relative difference count as equal.
SAME = 1e-10
_LOG_2 = float(np.log(2.0))
_BIG = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Made:
    """Genotypes, or a field of them, that a kernel makes of columns in the worker that adds them up, so many rows at a time."""

    kernel: Callable[..., pa.Array]
    columns: list
    rows: int
    kind: str = ""  # the type of what is made, where a schema has to tell it

    def __reduce__(self):  # a worker knows columns by their count
        return Made, (self.kernel, [None] * len(self.columns), self.rows)


def slices(batch: pa.RecordBatch, made: Made | None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Stretches of a batch with their genotypes: its last column, or what is made of its last columns."""
    if made is None:
        yield batch, batch.column(batch.num_columns - 1)
        return
    given = batch.num_columns - len(made.columns)
    for at in range(0, batch.num_rows, made.rows):
        part = batch.slice(at, made.rows)
        yield part, made.kernel(*part.columns[given:])


#: Genotypes that a worker makes or reads at a time: about what its caches hold.
STRETCH = 1 << 18


def stretched(f: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """f of a column, by slices of some rows where these hold many genotypes: what it needs besides is then that of a slice, and stays in caches."""

    @functools.wraps(f)
    def run(column: pa.Array) -> pa.Array:
        if pa.types.is_binary(column.type):
            cells = pc.sum(pc.binary_length(column)).as_py() or 0
        else:
            cells = 2 * len(column.flatten()) if pa.types.is_list(column.type) else 0
        rows = max(1, 2 * STRETCH * len(column) // max(1, cells))
        if rows >= len(column):
            return f(column)
        return pa.concat_arrays([f(column.slice(at, rows)) for at in range(0, len(column), rows)])

    return run


def batch_of(columns: tuple[pa.Array, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def lengths(column: pa.Array) -> np.ndarray:
    """The lengths of the lists; null ones have none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType, nulls: np.ndarray | None = None) -> pa.Array:
    """Lists of so many of the values each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    made = pa.ListArray.from_arrays(offsets, pa.array(values, kind))
    return made if nulls is None or not nulls.any() else pc.if_else(pa.array(~nulls), made, pa.scalar(None, made.type))


def nulls_of(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def struct(fields: dict[str, pa.Array], nulls: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields), mask=None if nulls is None else pa.array(nulls))


def floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, whether it is null) of each element of a column of numeric arrays."""
    n, flat = lengths(column), column.flatten()
    return np.repeat(np.arange(len(n)), n), pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False), nulls_of(flat)


def grid(column: pa.Array) -> pa.Array | None:
    """The flat values of lists that are all of one length over zero, none of them null; else None."""
    n = lengths(column)
    return column.flatten() if len(n) and n[0] and not column.null_count and (n == n[0]).all() else None


def whole_moments(column: pa.Array) -> pa.Array | None:
    """array_summary_stats of arrays of one length of integers so small that their sums of squares are exact; else None."""
    flat = grid(column) if pa.types.is_int32(column.type.value_type) else None
    if flat is None:
        return None
    x, known = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(len(column), -1), None
    n, low, high = np.full(len(x), x.shape[1]), x.min(1).astype(np.float64), x.max(1).astype(np.float64)
    if max(-low.min(), high.max()) * x.shape[1] >= 1 << 31:
        return None
    if flat.null_count:
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
        n = np.array([np.count_nonzero(k) for k in known])
        low = np.where(known, x, _BIG).min(1).astype(np.float64)
        if not (high > 0).all():  # else no null, which is zero here, is the largest
            high = np.where(known, x, -_BIG - 1).max(1).astype(np.float64)
    sums, most = x.sum(1, dtype=np.int32).astype(np.int64), max(abs(float(low.min())), abs(float(high.max())))  # below 2^31, as said above
    squares = np.einsum("ij,ij->i", x, x) if most * most * x.shape[1] < 1 << 31 else np.einsum("ij,ij->i", x, x, dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.sqrt((n * squares.astype(np.int64) - sums * sums) / n / (n - 1))
        mean = sums / n
    return struct({k: pa.array(v, pa.float64(), mask=n == 0) for k, v in (("mean", mean), ("stdDev", deviation), ("min", low), ("max", high))})


def even_moments(column: pa.Array) -> pa.Array | None:
    """array_summary_stats of arrays of doubles of one length, without nulls and NaN; else None."""
    flat = grid(column) if pa.types.is_float64(column.type.value_type) else None
    if flat is None or flat.null_count:
        return None
    x = flat.to_numpy().reshape(len(column), -1)
    total, n = x.sum(1), x.shape[1]
    if np.isnan(total).any():
        return None
    mean = total / n
    with np.errstate(divide="ignore", invalid="ignore"):
        away = x - mean.reshape(-1, 1)
        deviation = np.sqrt(np.einsum("ij,ij->i", away, away) / (n - 1))
    return struct({k: pa.array(v, pa.float64(), from_pandas=False) for k, v in (("mean", mean), ("stdDev", deviation), ("min", x.min(1)), ("max", x.max(1)))})


@stretched
def array_summary_stats(column: pa.Array) -> pa.Array:
    """struct(mean, stdDev, min, max) of each array's elements that are not null."""
    made = whole_moments(column)
    made = even_moments(column) if made is None else made
    if made is not None:
        return made
    rows = len(column)
    row, x, gone = floats(column)
    row, x = row[~gone], x[~gone]
    n = np.bincount(row, minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(row, x, rows) / n
        away = x - mean[row]
        deviation = np.sqrt(np.bincount(row, away * away, rows) / (n - 1))
    low, high = np.full(rows, np.nan), np.full(rows, np.nan)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        low[row[first]], high[row[first]] = np.fmin.reduceat(x, first), np.maximum.reduceat(x, first)  # NaN is the largest, as in SQL
    none = n == 0
    return struct({k: pa.array(v, pa.float64(), mask=none) for k, v in (("mean", mean), ("stdDev", deviation), ("min", low), ("max", high))}, nulls_of(column))


def mean_substitute(column: pa.Array, missing: np.ndarray) -> pa.Array:
    """The arrays with NaN, null and missing elements replaced by the mean of the others, or by missing if there are none."""
    rows, n = len(column), lengths(column)
    row, x, gone = floats(column)
    gone = gone | np.isnan(x) | (x == missing[row])
    known = np.bincount(row[~gone], minlength=rows)
    mean = np.where(known > 0, np.bincount(row[~gone], x[~gone], rows) / np.maximum(known, 1), missing)
    return lists(n, np.where(gone, mean[row], x), pa.float64(), nulls_of(column))


def unpacked(column: pa.Array) -> pa.Array:
    """Packed calls, two signed bytes for each genotype, as array<array<int>>."""
    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    flat = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.int8)
    each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat.astype(np.int32)))
    return pc.if_else(column.is_valid(), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), each), pa.scalar(None, pa.list_(each.type)))


def _packed(column: pa.Array) -> np.ndarray | None:
    """Packed calls of as many genotypes in each row: (rows, samples, 2); else None."""
    n = pc.binary_length(column)
    if column.null_count or not len(column) or not n[0].as_py() or n[0].as_py() % 2 or pc.min_max(n).as_py() != {"min": n[0].as_py(), "max": n[0].as_py()}:
        return None
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.int8)[first : first + len(column) * n[0].as_py()].reshape(len(column), -1, 2)


class Calls:
    """The calls of a column of genotypes: array<struct<calls, ..>>, array<array<int>>, or packed ones."""

    def __init__(self, column: pa.Array) -> None:
        column = unpacked(column) if pa.types.is_binary(column.type) else column
        self.nulls, self.samples = nulls_of(column), lengths(column)
        inner = column.flatten()
        if pa.types.is_struct(inner.type):
            inner = pc.struct_field(inner, "calls")
        self.rows, self.row = len(column), np.repeat(np.arange(len(column)), self.samples)
        self.sizes = lengths(inner)
        self.flat = pc.fill_null(inner.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        even = len(self.sizes) and (self.sizes == self.sizes[0]).all() and self.sizes[0] > 0
        if even:
            each = self.flat.reshape(-1, self.sizes[0])
            self.of = np.repeat(np.arange(len(each)), self.sizes[0])
            self.high, self.low = each.max(1), np.where(each >= 0, each, _BIG).min(1)
            missing = (each < 0).any(1)
        else:
            n = len(self.sizes)
            self.of = np.repeat(np.arange(n), self.sizes)
            self.high, self.low, known = np.full(n, -1, np.int32), np.full(n, _BIG, np.int32), self.flat >= 0
            np.maximum.at(self.high, self.of[known], self.flat[known])
            np.minimum.at(self.low, self.of[known], self.flat[known])
            missing = np.bincount(self.of[~known], minlength=n) > 0
        self.called = (self.sizes > 0) & ~missing
        self.het = (self.high >= 0) & (self.low < self.high)
        self.only = np.where(self.low == self.high, self.low, -1)

    def count(self, which: np.ndarray) -> np.ndarray:
        """Genotypes per row for which the flag is set."""
        return np.bincount(self.row[which], minlength=self.rows)

    def states(self) -> pa.Array:
        """Per genotype the sum of its calls, or -1 if it has none or any is missing."""
        total = np.bincount(self.of, self.flat, len(self.sizes)).astype(np.int32)
        return lists(self.samples, np.where(self.called, total, -1), pa.int32(), self.nulls)


#: Alleles up to which pairs of calls are counted in a table.
FEW_ALLELES = 30


def diploid(column: pa.Array) -> np.ndarray | None:
    """The calls (rows, samples, 2), missing ones -1, where all rows have as many samples and all genotypes two calls; else None."""
    if pa.types.is_binary(column.type):
        return _packed(column)
    inner = grid(column)
    if inner is not None and pa.types.is_struct(inner.type):
        inner = pc.struct_field(inner, "calls")
    flat = None if inner is None or not pa.types.is_list(inner.type) else grid(inner)
    if flat is None or len(flat) != 2 * len(inner) or flat.null_count or not pa.types.is_int32(flat.type):
        return None
    return flat.to_numpy().reshape(len(column), -1, 2)


#: Samples from which pairs of packed calls are counted by comparing each row with one pair after the other.
LONG_ROW = 4096


def _compared(pairs: np.ndarray, width: int) -> np.ndarray:
    """pair_counts of rows of packed pairs: a row's pairs are compared until all its genotypes are met."""
    codes = pair_codes(width).view(np.int16)
    out, order = np.zeros((len(pairs), width * width), np.int64), np.arange(width * width)
    for row, counts in zip(pairs, out):
        left = len(row)
        for k in order:
            counts[k] = np.count_nonzero(row == codes[k])
            left -= counts[k]
            if not left:
                break
        order = np.argsort(-counts, kind="stable")  # what is common in a row is looked for first in the next
    return out.reshape(-1, width, width)


def pair_counts(column: pa.Array) -> np.ndarray | None:
    """How often each pair of calls occurs in a row: (rows, first call + 1, second call + 1), missing calls at 0; None where calls are not so even, or of many alleles."""
    each = diploid(column)
    return None if each is None else pairs_counted(each)


def pairs_counted(each: np.ndarray) -> np.ndarray | None:
    high = int(each.max())
    if high >= FEW_ALLELES or each.min() < -1:
        return None
    width = high + 2
    if each.dtype == np.int8 and width <= 5 and each.shape[1] >= LONG_ROW and each.flags.c_contiguous:
        return _compared(each.view(np.int16)[:, :, 0], width)
    code = (each[:, :, 0] + 1) * np.int32(width) + each[:, :, 1] + (1 + np.arange(len(each)) * width * width).reshape(-1, 1)
    return np.bincount(code.reshape(-1), minlength=len(each) * width * width).reshape(-1, width, width)


@stretched
def states(column: pa.Array) -> pa.Array:
    """Per genotype the sum of its calls, or -1 if it has none or any is missing."""
    each = diploid(column)
    if each is None:
        return Calls(column).states()
    return lists(np.full(len(each), each.shape[1]), state_values(each).reshape(-1), pa.int32())


def state_values(each: np.ndarray) -> np.ndarray:
    """(rows, samples) of calls (rows, samples, 2)."""
    one, two = each[:, :, 0], each[:, :, 1]
    return np.where((one >= 0) & (two >= 0), one.astype(np.int32) + two, -1)


CALL_TOTALS = pa.struct([("n", pa.int64()), ("total", pa.int64()), ("products", pa.int64())])


@stretched
def call_totals(column: pa.Array) -> pa.Array:
    """struct(n, total, products) of diploid calls; a genotype with a missing first or second call has no product."""
    each = diploid(column)
    if each is not None:
        x, rows = each.reshape(len(each), -1), each.shape[1]
        one, two = each[:, :, 0], each[:, :, 1]
        products = (one * two * ((one >= 0) & (two >= 0))).sum(1, dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(np.full(len(x), rows, np.int64)), pa.array(x.sum(1, dtype=np.int64)), pa.array(products)], fields=list(CALL_TOTALS))
    out = []
    for genotypes in column.to_pylist():
        known = [c for c in genotypes or [] if c is not None and len(c) == 2 and None not in c]
        out.append({"n": len(genotypes or []), "total": sum(map(sum, known)), "products": sum(a * b for a, b in known if a >= 0 and b >= 0)})
    return pa.array(out, CALL_TOTALS)


def pair_codes(width: int) -> np.ndarray:
    """The packed pairs of calls from missing ones up to an allele, in the order of pair_counts."""
    return (np.stack(np.meshgrid(np.arange(width), np.arange(width), indexing="ij"), axis=2) - 1).astype(np.int8).reshape(-1, 2).view(np.uint16).reshape(-1)


def dosage_kinds(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counts of pairs: each pair's dosage in each row, each row's mean of the known ones (-1 if there are none), and whether dosages differ."""
    width, n = pairs.shape[1], pairs.reshape(len(pairs), -1)
    one, two = (x.reshape(-1) - 1 for x in np.meshgrid(np.arange(width), np.arange(width), indexing="ij"))
    total, called = one + two, (one >= 0) & (two >= 0)
    known = n[:, called].sum(1)
    mean = np.where(known > 0, n[:, called] @ total[called] / np.maximum(known, 1), -1.0)
    kinds = np.where(called, total, mean.reshape(-1, 1))
    low, high = np.where(n > 0, kinds, np.inf).min(1, initial=np.inf), np.where(n > 0, kinds, -np.inf).max(1, initial=-np.inf)
    return kinds, mean, low < high


def dosage_values(each: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Dosages of packed pairs (rows, samples), looked up in a table of each row's."""
    at, table, values = pair_codes(int(kinds.shape[1] ** 0.5)), np.zeros(1 << 16), np.empty(each.shape[:2])
    for row, own, out in zip(each.view(np.uint16)[:, :, 0], kinds, values):
        table[at] = own
        np.take(table, row, out=out, mode="wrap")
    return values


CALL_SUMS = pa.struct([("first", pa.int64()), ("second", pa.int64()), ("placed", pa.int64())])


@stretched
def call_sums(column: pa.Array) -> pa.Array:
    """struct(first, second, placed) of packed diploid calls: the sums of first and of second calls, and of first calls times their places from 1."""
    each = diploid(column)
    if each is not None and each.shape[1] < 1 << 23:  # sums of products are whole numbers below 2^53
        place = np.arange(1, each.shape[1] + 1, dtype=np.float64)
        sums = [each[:, :, 0].sum(1, dtype=np.int64), each[:, :, 1].sum(1, dtype=np.int64), (each[:, :, 0].astype(np.float64) @ place).astype(np.int64)]
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], fields=list(CALL_SUMS))
    out = []
    for x in column.to_pylist():
        own = np.frombuffer(x or b"", np.int8).reshape(-1, 2).astype(np.int64)
        out.append({"first": int(own[:, 0].sum()), "second": int(own[:, 1].sum()), "placed": int(own[:, 0] @ np.arange(1, len(own) + 1))})
    return pa.array(out, CALL_SUMS)


@stretched
def dosages(column: pa.Array) -> pa.Array:
    """struct(values, varies): states with unknown ones replaced by the mean of the others (-1 if there are none), and whether they differ."""
    each = diploid(column)
    if each is not None and each.dtype == np.int8 and each.flags.c_contiguous and (pairs := pairs_counted(each)) is not None:
        kinds, _, varies = dosage_kinds(pairs)
        values = dosage_values(each, kinds)
        return struct({"values": lists(np.full(len(each), each.shape[1]), values.reshape(-1), pa.float64()), "varies": pa.array(varies)})
    if each is not None:
        one, two = each[:, :, 0], each[:, :, 1]
        total, called = one.astype(np.int32) + two, (one >= 0) & (two >= 0)
        known = np.count_nonzero(called, axis=1)
        mean = np.where(known > 0, (total * called).sum(1, dtype=np.int64) / np.maximum(known, 1), -1.0)
        values = np.where(called, total, mean.reshape(-1, 1))
        varies = (values != values[:, :1]).any(1)
        return struct({"values": lists(np.full(len(each), each.shape[1]), values.reshape(-1), pa.float64()), "varies": pa.array(varies)})
    calls = Calls(column)
    total = np.bincount(calls.of, calls.flat, len(calls.sizes))
    known = np.bincount(calls.row[calls.called], minlength=calls.rows)
    mean = np.where(known > 0, np.bincount(calls.row[calls.called], total[calls.called], calls.rows) / np.maximum(known, 1), -1.0)
    values = np.where(calls.called, total, mean[calls.row])
    first = np.cumsum(calls.samples) - calls.samples
    differs = values != np.repeat(values[np.minimum(first, max(0, len(values) - 1))] if len(values) else np.zeros(calls.rows), calls.samples)
    varies = np.bincount(calls.row[differs], minlength=calls.rows) > 0
    return struct({"values": lists(calls.samples, values, pa.float64()), "varies": pa.array(varies)}, calls.nulls)


def tallied(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row how often each of 0 .. its largest value occurs: the lengths, and the counts one row after the other."""
    width = int(value.max()) + 1 if len(value) else 0
    table = np.bincount(row * max(width, 1) + value, minlength=rows * max(width, 1)).reshape(rows, -1)[:, :width]
    n = np.where(table > 0, np.arange(1, width + 1), 0).max(1) if width else np.zeros(rows, np.int64)
    return n, table[np.arange(width) < n[:, None]] if width else np.zeros(0, np.int64)


def trimmed(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tallied, of a table of the counts of each row."""
    n = np.where(table > 0, np.arange(1, table.shape[1] + 1), 0).max(1, initial=0)
    return n, table[np.arange(table.shape[1]) < n[:, None]]


def _only(pairs: np.ndarray) -> np.ndarray:
    """For each row and allele the genotypes in which it alone is known."""
    return np.diagonal(pairs, axis1=1, axis2=2)[:, 1:] + pairs[:, 0, 1:] + pairs[:, 1:, 0]


@stretched
def call_summary_stats(column: pa.Array) -> pa.Array:
    pairs = pair_counts(column)
    if pairs is None:
        c = Calls(column)
        known = c.flat >= 0
        n_alleles, counts = tallied(c.row[c.of[known]], c.flat[known], c.rows)
        n_hom, homs = tallied(c.row[c.only >= 0], c.only[c.only >= 0], c.rows)
        called, total = c.count(c.called), np.bincount(c.row[c.of[known]], minlength=c.rows)
        het, other, samples, nulls = c.count(c.het), c.count(c.high > 0), c.samples, c.nulls
    else:
        alleles, both = pairs.sum(1)[:, 1:] + pairs.sum(2)[:, 1:], pairs[:, 1:, 1:]
        (n_alleles, counts), (n_hom, homs) = trimmed(alleles), trimmed(_only(pairs))
        called, total, samples, nulls = both.sum((1, 2)), alleles.sum(1), pairs.sum((1, 2)), None
        het, other = called - np.trace(both, axis1=1, axis2=2), samples - pairs[:, :2, :2].sum((1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        rate, shares = called / samples, counts / np.repeat(total, n_alleles)
    whole = lambda x: pa.array(x, pa.int32())
    return struct({
        "callRate": pa.array(rate, pa.float64()), "nCalled": whole(called), "nUncalled": whole(samples - called), "nHet": whole(het), "nHomozygous": lists(n_hom, homs, pa.int32()),
        "nNonRef": whole(other), "nAllelesCalled": whole(total), "alleleCounts": lists(n_alleles, counts, pa.int32()), "alleleFrequencies": lists(n_alleles, shares, pa.float64()),
    }, nulls)


@functools.lru_cache(maxsize=2)
def _log_factorials(upto: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, upto + 1)))])


#: By so much the logarithm of a left out probability is below that of the observed count: all of them together are then less than 1e-15 of it.
NOTHING = 50.0


#: Counts of heterozygotes up to which all are looked at.
ALL_HETS = 2048


def _no_likelier_hets(n: int, minor: int, major: int, het: int, log_factorial: np.ndarray) -> np.ndarray:
    """Counts of heterozygotes that these alleles can have and that are no likelier than the observed one, which is among them; some others may be.

    Probabilities have one peak, so these are two ends; of an end, what is nothing beside the observed one is left out.
    """
    first = minor % 2
    last = (minor - first) // 2  # counts are first + 2 i
    if last < ALL_HETS:
        return np.arange(first, minor + 1, 2)

    def log(i: int) -> float:
        h = first + 2 * i
        return h * _LOG_2 - log_factorial[(minor - h) // 2] - log_factorial[h] - log_factorial[(major - h) // 2]

    peak = min(max(0, ((minor * major - 2) // (minor + major + 3) - first) // 2 + 1), last)
    at = (het - first) // 2
    own = log(at)
    up, down = range(peak + 1), range(peak, last + 1)
    left = [bisect.bisect_right(up, level, key=log) for level in (own - NOTHING, own)]  # counts of the rising side that are below
    right = [peak + bisect.bisect_left(down, -level, key=lambda i: -log(i)) for level in (own, own - NOTHING)]
    low = np.arange(max(0, left[0] - 1), min(peak, left[1] + 2))
    high = np.arange(max(peak, right[0] - 2), min(last, right[1] + 1) + 1)
    return first + 2 * np.unique(np.concatenate([low, high, [at]]))


@stretched
def hardy_weinberg(column: pa.Array) -> pa.Array:
    """struct(hetFreqHwe, pValueHwe), from the counts of heterozygotes and of both kinds of homozygotes."""
    pairs = pair_counts(column)
    if pairs is None:
        c = Calls(column)
        called, het, ref, alt, nulls = c.count(c.called), c.count(c.het), c.count(c.only == 0), c.count(c.only == 1), c.nulls
    else:
        both, only = pairs[:, 1:, 1:], np.pad(_only(pairs), ((0, 0), (0, 2)))
        called, ref, alt, nulls = both.sum((1, 2)), only[:, 0], only[:, 1], None
        het = called - np.trace(both, axis1=1, axis2=2)
    n, minor = het + ref + alt, het + 2 * np.minimum(ref, alt)
    major = 2 * n - minor
    log_factorial = _log_factorials(1 << (2 * int(n.max(initial=0))).bit_length())
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.where(n > 0, minor * major / np.maximum(2 * n - 1, 1) / called, np.nan)
    p = np.full(len(column), 0.5)
    for i in np.flatnonzero(n > 0):
        hets = _no_likelier_hets(int(n[i]), int(minor[i]), int(major[i]), int(het[i]), log_factorial)
        fixed = log_factorial[n[i]] + log_factorial[minor[i]] + log_factorial[major[i]] - log_factorial[2 * n[i]]
        each = np.exp(fixed + hets * np.log(2.0) - log_factorial[(minor[i] - hets) // 2] - log_factorial[hets] - log_factorial[(major[i] - hets) // 2])
        own = each[np.searchsorted(hets, het[i])]
        same = np.abs(each - own) <= SAME * np.maximum(each, own)
        p[i] = each[same].sum() / 2 + each[~same & (each < own)].sum()
    return struct({"hetFreqHwe": pa.array(expected, pa.float64()), "pValueHwe": pa.array(p, pa.float64())}, nulls)


#: Counts of a sample, in the order of sample_counts.
SAMPLE_COUNTS = ("nCalled", "nUncalled", "nHomRef", "nHet", "nHomVar", "nInsertion", "nDeletion", "nTransition", "nTransversion", "nSpanningDeletion")
TYPES = ("Insertion", "Deletion", "Transition", "Transversion", "SpanningDeletion")


def sample_counts(column: pa.Array, types: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each genotype its row, its place among the row's samples, and the counts of SAMPLE_COUNTS."""
    c = Calls(column)
    place = np.arange(len(c.row)) - np.repeat(np.cumsum(c.samples) - c.samples, c.samples)
    n_types = lengths(types)
    code = pc.fill_null(pc.index_in(types.flatten(), pa.array(TYPES)), len(TYPES)).to_numpy(zero_copy_only=False)
    start, at = np.cumsum(n_types) - n_types, c.row[c.of]
    alternate = (c.flat > 0) & (c.flat <= n_types[at])
    kind = np.full(len(c.flat), len(TYPES))
    kind[alternate] = code[start[at[alternate]] + c.flat[alternate] - 1]
    single = c.called & ~c.het
    flags = [c.called, ~c.called, single & (c.high == 0), c.called & c.het, single & (c.high > 0)]
    counts = np.stack([*(f.astype(np.int64) for f in flags), *(np.bincount(c.of[kind == k], minlength=len(c.row)) for k in range(len(TYPES)))])
    return c.row, place, counts


#: Bits of a counter of SAMPLE_COUNTS within a word, and the genotypes, of two alleles each, that it counts.
COUNTER, COUNTED = 6, 31


def place_counts(column: pa.Array, types: pa.Array) -> np.ndarray:
    """SAMPLE_COUNTS for each place among the rows' samples, added up over the rows.

    Where calls are even, what a pair of calls adds to all counters is one word, looked up for the row's kinds of alleles.
    """
    each = diploid(column)
    if each is None or each.max() >= FEW_ALLELES:
        _, place, counts = sample_counts(column, types)
        n = int(place.max(initial=-1)) + 1
        return np.stack([np.bincount(place, c, n) for c in counts]).astype(np.int64)
    n_types = lengths(types)
    code = pc.fill_null(pc.index_in(types.flatten(), pa.array(TYPES)), len(TYPES)).to_numpy(zero_copy_only=False)
    ends, width = np.cumsum(n_types), int(each.max()) + 2
    known, low = {}, each.min()
    total = np.zeros((len(SAMPLE_COUNTS), each.shape[1]), np.int64)
    for at in range(0, len(each), COUNTED):
        words = np.zeros(each.shape[1], np.int64)
        for i in range(at, min(at + COUNTED, len(each))):
            kinds = tuple(code[ends[i] - n_types[i] : ends[i]].tolist())
            if kinds not in known:
                known[kinds] = _words(kinds, width)
            calls = each[i] if low >= -1 else np.maximum(each[i], -1)
            words += known[kinds].take((calls[:, 0] + 1) * np.int32(width) + calls[:, 1] + np.int32(1))
        for k, own in enumerate(total):
            own += words >> COUNTER * k & (1 << COUNTER) - 1
    return total


def _words(kinds: tuple, width: int) -> np.ndarray:
    """What each pair of calls, from missing on, adds to the counters of a sample where alternate alleles are of these kinds."""
    out = np.zeros((width, width), np.int64)
    add = lambda a, b, name: out.__setitem__((a, b), out[a, b] + (1 << COUNTER * SAMPLE_COUNTS.index(name)))
    for a in range(-1, width - 1):
        for b in range(-1, width - 1):
            called = a >= 0 and b >= 0
            add(a + 1, b + 1, "nCalled" if called else "nUncalled")
            if called:
                add(a + 1, b + 1, "nHet" if a != b else "nHomRef" if a == 0 else "nHomVar")
            for allele in (a, b):
                if 0 < allele <= len(kinds) and kinds[allele - 1] < len(TYPES):
                    add(a + 1, b + 1, "n" + TYPES[kinds[allele - 1]])
    return out.reshape(-1)


#: Sums of a sample's integers, in the order of place_sums; squares are high times 2^32 plus low, so that no sum overflows.
SAMPLE_SUMS = ("n", "total", "high", "low", "min", "max")
#: What no value leaves as the least and the largest.
NO_LEAST, NO_MOST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
LOW = (1 << 32) - 1


def place_sums(column: pa.Array) -> np.ndarray:
    """SAMPLE_SUMS for each place among the rows' arrays of integers of 32 bits at most, nulls left out."""
    flat = grid(column)
    if flat is not None:
        x, known = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(len(column), -1), None
        if flat.null_count:
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
        most = max(abs(int(x.min())), abs(int(x.max()))) ** 2 * len(x)
        if most < 1 << 63:
            squares = np.einsum("ij,ij->j", x, x) if most < 1 << 31 and x.dtype == np.int32 else np.einsum("ij,ij->j", x, x, dtype=np.int64)
            high, low = squares.astype(np.int64) >> 32, squares.astype(np.int64) & LOW
        else:
            squares = x.astype(np.int64) ** 2
            high, low = (squares >> 32).sum(0), (squares & LOW).sum(0)
        total = x.sum(0, dtype=x.dtype if most * len(x) < 1 << 62 and x.dtype == np.int32 else np.int64)  # below 2^31
        if known is None:
            return np.stack([np.full(x.shape[1], len(x)), total, high, low, x.min(0), x.max(0)]).astype(np.int64)
        n = np.add.reduce(known.view(np.int8), axis=0, dtype=np.int8 if len(x) < 128 else np.int64).astype(np.int64)
        least, largest = np.where(known, x, np.iinfo(x.dtype).max).min(0).astype(np.int64), np.where(known, x, np.iinfo(x.dtype).min).max(0).astype(np.int64)
        return np.stack([n, total.astype(np.int64), high, low, np.where(n > 0, least, NO_LEAST), np.where(n > 0, largest, NO_MOST)])
    own, flat = lengths(column), column.flatten()
    place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    known, width = flat.is_valid().to_numpy(zero_copy_only=False), int(own.max(initial=0))
    place, x = place[known], flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(SAMPLE_SUMS), width), np.int64)
    out[4], out[5] = NO_LEAST, NO_MOST
    for k, (way, v) in enumerate(((np.add, np.ones_like(x)), (np.add, x), (np.add, x * x >> 32), (np.add, x * x & LOW), (np.minimum, x), (np.maximum, x))):
        way.at(out[k], place, v)
    return out
