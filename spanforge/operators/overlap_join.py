"""Overlap joins of interval frames (Chromosome, Start, End, further columns; half-open: touching intervals don't overlap).

Pairs. Every interval has a level by its length; its bins have the width of the level, so that it lies in at most two.
Two intervals meet in the bins of the greater of their levels: there the one of that level is looked up in its own bins
and the other in the bins of that width. Rows are joined on equality of (contig, level, bin, side), so a contig that
holds a third of all rows is spread over its bins, a long interval does not explode into thousands of bins, and nothing
is crossed. A pair comes out once, from the bin in which the later of both starts. The narrowest width and the levels in
use come from one pass over the lengths of each side.

Merging groups the pairs by the left interval and joins the result back to the left side.

Defined results: rows with a null in a coordinate or an end not after the start overlap nothing; with ``how="left"`` they
come out with N 0. Left intervals must be distinct by coordinates for merges; null and NaN values count in N, not in the
statistics; without an overlap N is 0 and the statistics are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.frames import COORDS
from spanforge.operators.ordered import running

STEP_BITS = 3
_R = {"Chromosome": "_rc", "Start": "Start_b", "End": "End_b"}


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("Chromosome").isNotNull() & (F.col("End") > F.col("Start")))


def _sizes(df: DataFrame) -> tuple[float, list[int]]:
    """(mean length, powers of two that cover the lengths)."""
    n = F.col("End") - F.col("Start")
    mean, bits = _valid(df).agg(F.avg(n), F.collect_set(F.ceil(F.log2(n)))).first()
    return mean or 1.0, sorted(bits or [])


def overlap_pairs(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """All overlapping pairs: the columns of ``left``, Start_b and End_b, and the other columns of ``right`` (which must
    not have names of the left side). ``strict`` is for sides known to be valid."""
    if not strict:
        left, right = _valid(left), _valid(right)
    (mean_a, bits_a), (mean_b, bits_b) = _sizes(left), _sizes(right)
    base = max(6, math.ceil(math.log2(max(mean_a, mean_b))) + 1)

    def level_of(bits: int) -> int:
        return max(0, -(-(bits - base) // STEP_BITS))

    def level(s: str, e: str) -> Column:
        return F.greatest(F.ceil((F.ceil(F.log2(F.col(e) - F.col(s))) - base) / STEP_BITS), F.lit(0)).cast("int")

    levels_a, levels_b = ({level_of(b) for b in bits} for bits in (bits_a, bits_b))

    def keyed(df: DataFrame, s: str, e: str, own: int, others: set[int]) -> DataFrame:
        """Rows per (level, side, bin): side ``own`` at the level of the row, the other one at the levels above (for the
        left side, which is ``own`` 0, not at the same level again)."""
        seats = [F.array(F.struct(F.col("_l").alias("level"), F.lit(own).alias("side")))]
        for m in sorted(others):
            above = (F.col("_l") < m) if own == 0 else (F.col("_l") <= m)
            seats.append(F.when(above, F.array(F.struct(F.lit(m).alias("level"), F.lit(1 - own).alias("side")))).otherwise(F.array()))
        t = df.withColumn("_l", level(s, e)).withColumn("_seat", F.explode(F.concat(*seats))).withColumns({"_level": F.col("_seat.level"), "_side": F.col("_seat.side")})
        w = F.pow(F.lit(2.0), F.lit(base) + STEP_BITS * F.col("_level"))
        bins = F.sequence(F.floor(F.col(s) / w), F.floor((F.col(e) - 1) / w))
        return t.withColumn("_bin", F.explode(bins)).drop("_seat", "_l")

    a = keyed(left, "Start", "End", 0, levels_b)
    b = keyed(right.withColumnsRenamed(_R), "Start_b", "End_b", 1, levels_a)
    on = (a["Chromosome"] == b["_rc"]) & (a["_level"] == b["_level"]) & (a["_side"] == b["_side"]) & (a["_bin"] == b["_bin"])
    later = F.floor(F.greatest("Start", "Start_b") / F.pow(F.lit(2.0), F.lit(base) + STEP_BITS * a["_level"]))
    pairs = a.join(b, on).where((F.col("Start") < F.col("End_b")) & (F.col("Start_b") < F.col("End")) & (a["_bin"] == later))
    rest = [c for c in right.columns if c not in COORDS]
    return pairs.select(*left.columns, "Start_b", "End_b", *rest)


def overlap_length() -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least("End", "End_b") - F.greatest("Start", "Start_b"))


# ---- merging ----


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _skew(c: str) -> Column:
    """Skewness with the correction for small samples; 0 for equal values, null below 3."""
    v, n = _number(c), F.count(_number(c)).cast("double")
    plain = F.when(F.var_pop(v) < 1e-14, 0.0).otherwise(F.skewness(v))
    return F.when(n >= 3, plain * F.sqrt(n * (n - 1)) / (n - 2))


def _by(c: str, pick: Callable, *order: Column) -> Column:
    return pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))


_SPAN = ("Start_b", "End_b")


def merges(weight: str = "right_length", ddof: int = 0) -> dict[str, Callable[[str], Column]]:
    """The aggregates by name; ``weight`` of weighted_mean is ``right_length`` or ``overlap``."""
    w = overlap_length() if weight == "overlap" else F.col("End_b") - F.col("Start_b")
    size = F.col("End_b") - F.col("Start_b")
    std, var = (F.stddev_pop, F.var_pop) if ddof == 0 else (F.stddev_samp, F.var_samp)
    return {
        "mean": lambda c: F.avg(_number(c)), "std": lambda c: std(_number(c)), "var": lambda c: var(_number(c)),
        "min": lambda c: F.min(_number(c)), "max": lambda c: F.max(_number(c)), "median": lambda c: F.median(_number(c)), "skew": _skew,
        "first": lambda c: _by(c, F.min_by, *map(F.col, _SPAN)), "last": lambda c: _by(c, F.max_by, *map(F.col, _SPAN)),
        "longest": lambda c: _by(c, F.max_by, size, -F.col("Start_b")), "shortest": lambda c: _by(c, F.min_by, size, F.col("Start_b")),
        "weighted_mean": lambda c: F.try_divide(F.sum(_number(c) * w), F.sum(F.when(_number(c).isNotNull(), w))),
    }


def winsorized(pairs: DataFrame, columns: Sequence[str], limits: tuple[float, float]) -> DataFrame:
    """Values per left interval clamped to the order statistics that cut int(low * n) and int(high * n) values off."""
    for c in columns:
        v = _number(c)
        group = Window.partitionBy(*COORDS)
        t = pairs.withColumns({"_v": v, "_n": F.count(v).over(group), "_i": F.row_number().over(group.orderBy(v.asc_nulls_last()))})
        low = F.max(F.when(F.col("_i") == F.floor(F.col("_n") * limits[0]) + 1, F.col("_v"))).over(group)
        high = F.max(F.when(F.col("_i") == F.col("_n") - F.floor(F.col("_n") * limits[1]), F.col("_v"))).over(group)
        pairs = t.withColumn(c, F.when(F.col("_v").isNotNull(), F.least(F.greatest("_v", low), high))).select(*pairs.columns)
    return pairs


def overlap_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str] | str, merge: Sequence[str] | Mapping[str, Callable[[str], Column]] = ("mean", "std"), how: str = "left",
    ddof: int = 0, weight: str = "right_length", winsorize: tuple[float, float] | None = None, n_name: str | None = "N", find_nearest: bool = False,
) -> DataFrame:
    """Columns of ``left``, N and ``<column>_<merge>`` for right columns over the overlapping right intervals.

    ``merge`` names built-in aggregates or maps names to functions from a column name to an aggregate (also a grouped
    pandas UDF). ``find_nearest`` takes the nearest right interval where none overlaps (N stays 0). ``how`` is left or inner.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    known = merges(weight, ddof)
    aggs = {m: known[m] for m in merge} if not isinstance(merge, Mapping) else dict(merge)
    clash = [c for c in (n_name, *[f"{c}_{m}" for c in columns for m in aggs]) if c in left.columns]
    if clash:
        raise ValueError(f"the left side has columns named {clash}")
    a, b = _valid(left.select(*COORDS)), _valid(right.select(*COORDS, *[F.col(c).alias(f"_b_{c}") for c in columns]))
    pairs = overlap_pairs(a, b, strict=True)
    names = [f"_b_{c}" for c in columns]
    if winsorize:
        pairs = winsorized(pairs, names, winsorize)
    outs = [agg(f"_b_{c}").alias(f"{c}_{m}") for c in columns for m, agg in aggs.items()]
    merged = pairs.groupBy(*COORDS).agg(F.count(F.lit(1)).alias("_n"), *outs)
    if find_nearest:
        lone = a.distinct().join(merged, list(COORDS), "left_anti")
        near = nearest_beside(lone, b)
        merged = merged.unionByName(near.groupBy(*COORDS).agg(F.lit(0).cast("long").alias("_n"), *outs))
    key = [F.col(c).alias(f"_k_{c}") for c in COORDS]
    merged = merged.select(*key, "_n", *[f"{c}_{m}" for c in columns for m in aggs])
    on = (left["Chromosome"] == merged["_k_Chromosome"]) & (left["Start"] == merged["_k_Start"]) & (left["End"] == merged["_k_End"])
    joined = left.join(merged, on, how)
    count = [F.coalesce("_n", F.lit(0).cast("bigint")).alias(n_name)] if n_name else []
    return joined.select(*[left[c] for c in left.columns], *count, *[f"{c}_{m}" for c in columns for m in aggs])


# ---- predicates ----


def overlapping(left: DataFrame, right: DataFrame, negate: bool = False) -> DataFrame:
    """Left rows that overlap any right row, each once (those that overlap none, with ``negate``)."""
    hits = overlap_pairs(_valid(left.select(*COORDS)).distinct(), right.select(*COORDS)).select(*COORDS).distinct()
    return left.join(hits, list(COORDS), "left_anti" if negate else "left_semi")


def overlap_flag(left: DataFrame, right: DataFrame, name: str = "overlaps") -> DataFrame:
    """Adds whether a row overlaps any right row."""
    hits = overlap_pairs(_valid(left.select(*COORDS)).distinct(), right.select(*COORDS)).select(*[F.col(c).alias(f"_h_{c}") for c in COORDS]).distinct()
    on = (left["Chromosome"] == hits["_h_Chromosome"]) & (left["Start"] == hits["_h_Start"]) & (left["End"] == hits["_h_End"])
    return left.join(hits, on, "left").select(*[left[c] for c in left.columns], F.col("_h_Start").isNotNull().alias(name))


def count_overlaps(left: DataFrame, right: DataFrame, name: str = "NumberOverlaps") -> DataFrame:
    """Adds the number of overlapping right rows."""
    return overlap_join(left, right, [], {}, n_name=name)


def subset_regions(df: DataFrame, regions: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows once per region they overlap; once at all with ``distinct``."""
    return overlapping(df, regions) if distinct else overlap_pairs(df, regions.select(*COORDS)).select(*df.columns)


# ---- nearest ----


def nearest_beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """For left rows that overlap nothing: the nearest right row (of equally near ones that before it) with Distance.

    Two as-of lookups over the events of both sides: the right row that ends last at or before the start, and the one
    that starts first at or after the end. ``left`` has coordinates only.
    """
    rest = [c for c in right.columns if c not in COORDS]
    payload = F.struct(F.col("Start").alias("Start_b"), F.col("End").alias("End_b"), *rest)
    null = F.lit(None)

    def events(left_pos: str, right_pos: str, first: int) -> DataFrame:
        r = _valid(right).select("Chromosome", F.col(right_pos).alias("pos"), F.lit(first).alias("rank"), null.cast("long").alias("Start"), null.cast("long").alias("End"), F.struct(F.col(right_pos).alias("at"), payload.alias("row")).alias("b"))
        left_rows = left.select("Chromosome", F.col(left_pos).alias("pos"), F.lit(1 - first).alias("rank"), "Start", "End", null.cast(r.schema["b"].dataType).alias("b"))
        return r.unionByName(left_rows)

    def asof(t: DataFrame, how: str, reverse: bool) -> DataFrame:
        t = running(t, ["Chromosome"], F.col("b"), how, "hit", pos="pos", order=("pos", "rank"), reverse=reverse)
        return t.where(F.col("Start").isNotNull() & F.col("hit").isNotNull()).select(*COORDS, F.col("hit.row").alias("row"))

    before = asof(events("Start", "End", 0), "max", False).withColumn("Distance", F.col("Start") - F.col("row.End_b")).withColumn("_side", F.lit(0))
    after = asof(events("End", "Start", 1), "min", True).withColumn("Distance", F.col("row.Start_b") - F.col("End")).withColumn("_side", F.lit(1))
    best = before.unionByName(after).groupBy(*COORDS).agg(F.min_by(F.struct("row", "Distance"), F.struct("Distance", "_side")).alias("x"))
    return best.select(*COORDS, "x.row.*", "x.Distance")


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with the nearest right row and Distance: 0 for an overlapping one (the first by start and end)."""
    rest = [c for c in right.columns if c not in COORDS]
    a = _valid(left.select(*COORDS)).distinct()
    pairs = overlap_pairs(a, right)
    hit = pairs.groupBy(*COORDS).agg(F.min_by(F.struct("Start_b", "End_b", *rest), F.struct("Start_b", "End_b")).alias("x")).select(*COORDS, "x.*", F.lit(0).cast("long").alias("Distance"))
    beside = nearest_beside(a.join(hit, list(COORDS), "left_anti"), right)
    return left.join(hit.unionByName(beside), list(COORDS), "left")
