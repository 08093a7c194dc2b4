"""Running aggregates along an axis that spread a hot key over tasks.

A window by key alone puts all rows of a contig or entity into one task. Here the axis is cut into tiles; a window runs
inside each tile, the tiles of a key are aggregated to a row each, and what stands before a tile is added to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanforge.runtime import materialize

TILE = 1 << 20
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Run:
    """``name``: the sum, max or min (``how``) of ``value`` over the rows before a row (behind it, with ``reverse``)."""

    name: str
    value: Column
    how: str
    reverse: bool = False


def running_all(df: DataFrame, keys: Sequence[str], runs: Sequence[Run], pos: str = "Start", order: Sequence[str] = ("Start", "End"), tile: int = TILE) -> DataFrame:
    """``df`` with a column per run, null where no row stands before. ``order`` begins with ``pos``, which must not be null;
    rows that are equal in the order stand in any order to each other.

    All runs share one shuffle of the rows and one of the tiles. ``df`` is evaluated twice (rows and tiles), so chains of
    calls are cut by ``materialize``.
    """
    keys = list(keys)
    t = df.withColumns({"_tile": F.floor(F.col(pos) / F.lit(tile)), **{f"_v{i}": r.value for i, r in enumerate(runs)}})
    per = t.groupBy(*keys, "_tile").agg(*[_AGG[r.how](f"_v{i}").alias(f"_t{i}") for i, r in enumerate(runs)])

    def before(parts: Sequence[str], by: Sequence[str], reverse: bool) -> WindowSpec:
        return Window.partitionBy(*parts).orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in by]).rowsBetween(Window.unboundedPreceding, -1)

    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_tile").alias("_u"), *[_AGG[r.how](f"_t{i}").over(before(keys, ["_tile"], r.reverse)).alias(f"_o{i}") for i, r in enumerate(runs)])
    on = F.col("_tile") == F.col("_u")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    t = t.withColumns({f"_i{i}": _AGG[r.how](f"_v{i}").over(before([*keys, "_tile"], order, r.reverse)) for i, r in enumerate(runs)}).join(per, on)

    def both(i: int, how: str) -> Column:
        inner, outer = F.col(f"_i{i}"), F.col(f"_o{i}")
        if how == "sum":
            return F.when(inner.isNull(), outer).otherwise(inner + F.coalesce(outer, F.lit(0)))
        return (F.greatest if how == "max" else F.least)(inner, outer)

    return t.select(*df.columns, *[both(i, r.how).alias(r.name) for i, r in enumerate(runs)])


def running(df: DataFrame, keys: Sequence[str], value: Column, how: str, name: str, pos: str = "Start", order: Sequence[str] = ("Start", "End"), reverse: bool = False, tile: int = TILE) -> DataFrame:
    """One run (see ``running_all``)."""
    return running_all(df, keys, [Run(name, value, how, reverse)], pos, order, tile)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row") -> DataFrame:
    """``df`` with the number of each row (from 0) in the given order, without a task that sees all rows: range
    partitions are numbered inside, and the sizes of the partitions before them are added."""
    ids = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    t = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(ids, 33).alias("_part"), ids.bitwiseAND(low).alias("_local")))
    sizes = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return t.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))
