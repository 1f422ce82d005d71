"""Interval overlap joins as equi-joins on bins of several sizes.

Half-open intervals overlap if each starts before the other ends. Bins form levels, each of eight
times the size of the one below. An interval is dealt to the bins that it touches at the lowest level
where these are eight at most; two that overlap meet at the higher one of their levels, and the pair
is kept only in the bin where the later one starts. So the rows of an interval are bounded, however
long it is.

What left rows cost is one copy for each level that right is dealt at. As right is mostly the smaller
side, its counts by length are read first, and its shorter intervals stay at the lowest level as long
as their rows are few. Left rows with a single bin join directly; others are told apart by an id.
By the same counts right is shuffled where it is larger than what the driver and each executor should
hold: Spark itself goes by the compressed size of files, of which rows and their copies are many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import let

BIN_SIZE = 5000
#: Levels of bins; the last one is a single bin for all that is longer.
LEVELS, FANOUT = 9, 8
#: Rows that right may be dealt to at the lowest level: so many for each interval, or so many in all.
ROWS_EACH, ROWS_IN_ALL = 8, 1_000_000
#: Rows of right, with their copies, up to which Spark may broadcast them.
BROADCAST_ROWS = 200_000


def _defaults(left: DataFrame, right: DataFrame, ls, rs, le, re, extra) -> tuple[Column, Column, Column, Column, Column]:
    def pick(given, df: DataFrame, name: str) -> Column:
        if given is not None:
            return df[given] if isinstance(given, str) else given
        if name not in df.columns:
            raise ValueError(f"no {name} column was given and there is none of that name")
        return df[name]

    if extra is None and "contigName" in left.columns and "contigName" in right.columns:
        extra = left["contigName"] == right["contigName"]
    return pick(ls, left, "start"), pick(rs, right, "start"), pick(le, left, "end"), pick(re, right, "end"), F.lit(True) if extra is None else extra


def _ends(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last place; empty and reversed intervals have those of their ends, and those with a null none."""
    whole = start.isNotNull() & end.isNotNull()
    return F.when(whole, F.least(start, end - 1)), F.when(whole, F.greatest(start, end - 1))


def _level(first: Column, last: Column, size: int) -> Column:
    """The lowest level at which the interval touches eight bins at most."""
    limits = F.array(*[F.lit((FANOUT - 1) * size * FANOUT**k) for k in range(LEVELS - 1)])
    return let(last - first, lambda n: F.when(n.isNotNull(), F.size(F.filter(limits, lambda limit: n > limit))))


def _bin(place: Column, level: Column | int, size: int) -> Column:
    sizes = [size * FANOUT**k for k in range(LEVELS - 1)]
    if isinstance(level, int):
        return F.floor(place / sizes[level]) if level < LEVELS - 1 else F.when(place.isNotNull(), F.lit(0).cast("long"))
    return F.coalesce(F.floor(place / F.get(F.array(*map(F.lit, sizes)), level)), F.when(place.isNotNull(), F.lit(0)))


def _dealt(first: Column, last: Column, level: Column, size: int, key: Column) -> Column:
    """array<struct<key, bin, lo>>: the bins that the interval touches at a level."""
    ends = F.struct(_bin(first, level, size).alias("lo"), _bin(last, level, size).alias("hi"), key.cast("int").alias("key"))
    return let(ends, lambda e: F.transform(F.sequence(e["lo"], e["hi"]), lambda b: F.struct(e["key"].alias("key"), b.alias("bin"), e["lo"].alias("lo"))))


def _lengths(right: DataFrame, rs: Column, re: Column, size: int) -> list[tuple[int, int, int]]:
    """(level, intervals, lowest bins that they touch) of right, a row for each level."""
    first, last = _ends(rs, re)
    bins = _bin(last, 0, size) - _bin(first, 0, size) + 1
    counts = right.select(_level(first, last, size).alias("level"), bins.alias("bins")).where("level is not null")
    return sorted((r["level"], r["n"], r["bins"]) for r in counts.groupBy("level").agg(F.count("*").alias("n"), F.sum("bins").alias("bins")).collect())


def _dealing(found: list[tuple[int, int, int]]) -> tuple[int, list[int], int]:
    """What _lowest says, and how many rows right has at most with its copies."""
    budget, total, top = max(ROWS_IN_ALL, ROWS_EACH * sum(n for _, n, _ in found)), 0, 0
    for level, _, bins_of in found:
        total += bins_of
        if total > budget:
            break
        top = level
    copies = sum((bins_of if level <= top else FANOUT * n) + (LEVELS - 1) * n for level, n, bins_of in found)
    return top, sorted({0 if level <= top else level for level, _, _ in found}), copies


def _lowest(right: DataFrame, rs: Column, re: Column, size: int) -> tuple[int, list[int]]:
    """The level up to which right's intervals are dealt to lowest bins, and all levels that right is dealt at."""
    return _dealing(_lengths(right, rs, re, size))[:2]


def _names(*frames: DataFrame) -> list[str]:
    have = {c.lower() for f in frames for c in f.columns}
    out = []
    for stem in ("lo", "hi", "bin", "at", "at_r", "row", "row_m"):
        name = f"__{stem}"
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def _join(left, right, ls, rs, le, re, extra, prefix, size, semi):
    ls, rs, le, re, extra = _defaults(left, right, ls, rs, le, re, extra)
    lo, hi, bin_, at, at_r, row, row_m = _names(left, right)
    overlap = (ls < re) & (rs < le) & extra
    top, levels, copies = _dealing(_lengths(right, rs, re, size))
    met_by = lambda df: df if copies <= BROADCAST_ROWS else df.hint("merge")
    out_left = [left[c] for c in left.columns]
    out_right = [] if semi else [right[c].alias(prefix + c) if prefix else right[c] for c in right.columns]

    # where right has one level, left rows within one bin of it meet it there and nowhere else
    first, last = _ends(ls, le)
    first_r, last_r = _ends(rs, re)
    only = levels[0] if levels else 0
    lefts = left.select("*", _bin(first, only, size).alias(lo), _bin(last, only, size).alias(hi))
    lone = F.col(hi).isNull() | (F.col(lo) == F.col(hi)) if len(levels) < 2 else F.col(hi).isNull()
    rights = right.where(F.lit(len(levels) < 2)).select("*", F.explode(F.sequence(_bin(first_r, only, size), _bin(last_r, only, size))).alias(bin_))
    single = lefts.where(lone).join(met_by(rights), (F.col(lo) == F.col(bin_)) & overlap, "left_semi" if semi else "left_outer").select(*out_left, *out_right)

    # others are dealt to each level of right that is not below their own, and to their own for right's shorter intervals, which
    # are dealt to all levels above theirs under keys from LEVELS on
    def places(e: Column) -> Column:
        given = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= e["level"])
        each = F.transform(given, lambda k: _dealt(e["first"], e["last"], k, size, k))
        own = F.when(e["level"] > levels[0], F.array(_dealt(e["first"], e["last"], e["level"], size, e["level"] + LEVELS))).otherwise(F.slice(each, 1, 0))
        return F.flatten(F.concat(each, own))

    def places_r(e: Column) -> Column:
        above = F.filter(F.sequence(F.lit(1), F.lit(LEVELS - 1)), lambda k: k > e["level"])
        each = F.transform(above, lambda k: _dealt(e["first"], e["last"], k, size, k + LEVELS))
        return F.concat(_dealt(e["first"], e["last"], e["level"], size, e["level"]), F.flatten(each))

    if not levels:
        return single
    level_r = _level(first_r, last_r, size)
    ends = F.struct(first.alias("first"), last.alias("last"), _level(first, last, size).alias("level"))
    ends_r = F.struct(first_r.alias("first"), last_r.alias("last"), F.when(level_r > top, level_r).otherwise(0).alias("level"))
    every = right.where(first_r.isNotNull()).select("*", F.explode(let(ends_r, places_r)).alias(at_r))
    # a row and its copies come from one evaluation, so their common id holds whatever left is made of
    far = lefts.where(~lone).select(*out_left, F.monotonically_increasing_id().alias(row), let(ends, places).alias(at))
    spread = far.select(*out_left, row, F.explode(at).alias(at))
    here = (F.col(f"{at}.key") == F.col(f"{at_r}.key")) & (F.col(f"{at}.bin") == F.col(f"{at_r}.bin")) & (F.col(f"{at}.bin") == F.greatest(F.col(f"{at}.lo"), F.col(f"{at_r}.lo"))) & overlap
    if semi:
        return single.union(spread.join(met_by(every), here, "left_semi").dropDuplicates([row]).select(*out_left))
    met = spread.join(met_by(every), here, "left_outer")
    own_rows = Window.partitionBy(row)
    met = met.select(*out_left, *out_right, F.col(at_r), F.col(row), F.count(at_r).over(own_rows).alias(row_m), F.row_number().over(own_rows.orderBy(f"{at}.key", f"{at}.bin")).alias(at))
    return single.union(met.where(F.col(at_r).isNotNull() | ((F.col(row_m) == 0) & (F.col(at) == 1))).drop(at_r, row, row_m, at))


def left_overlap_join(left: DataFrame, right: DataFrame, left_start=None, right_start=None, left_end=None, right_end=None, extra_join_expr: Column | None = None, right_prefix: str | None = None, bin_size: int = BIN_SIZE) -> DataFrame:
    """Left outer join on overlap of [start, end) and an extra condition.

    Without one, rows of the same contigName meet if both sides have that column. right_prefix is
    put before the names of right's columns. A row of left is told apart by nothing but itself, so left
    may hold columns that come out differently each time; its intervals must not.
    """
    return _join(left, right, left_start, right_start, left_end, right_end, extra_join_expr, right_prefix, bin_size, False)


def left_semi_overlap_join(left: DataFrame, right: DataFrame, left_start=None, right_start=None, left_end=None, right_end=None, extra_join_expr: Column | None = None, bin_size: int = BIN_SIZE) -> DataFrame:
    """The rows of left that overlap any row of right."""
    return _join(left, right, left_start, right_start, left_end, right_end, extra_join_expr, None, bin_size, True)
