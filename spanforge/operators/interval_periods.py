"""Merging overlapping intervals of an entity into continuous periods and listing the gaps between them.

The aggregate is a sorted list of disjoint intervals. Every Arrow batch of the input is reduced to one list per entity
and tile of the axis (``start div tile``), lists of one tile are merged as they come, and tiles are joined through a
summary of at most three rows each (the largest end so far, the first and the last interval), so that an entity that
holds a third of all rows is spread over its tiles: no task ever holds more than one tile of an entity, whose list has
at most ``tile/2`` members, and the summaries of an entity, of which there are at most TILES.

Defined results: intervals are half-open; touching ones merge; rows with a null key, start or end, or with an end not
after the start, are left out; copies change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.runtime import bounded_slices, materialize

#: Least width of a tile on the axis, and the most tiles that the observed range is cut into.
TILE, TILES = 1 << 20, 1 << 16
#: Bytes of lists that a task merges at once.
STEP = 32 << 20


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of each group, sorted by group and start; touching intervals become one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    values, rank = np.unique(e, return_inverse=True)  # ranks, so that the group offset can't overflow
    _, dense = np.unique(g, return_inverse=True)
    top = values[np.maximum.accumulate(rank + dense * len(values)) - dense * len(values)]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] > top[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(g)) - 1
    return g[at], s[at], top[last]


def _lists(g: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.searchsorted(g, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(e))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys.., tile, s, e) to one list per key and tile of the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.table(b)
        keys = t.column_names[:-2]
        groups = t.append_column("_i", pa.array(np.arange(len(t)))).group_by(keys).aggregate([("_i", "list")])
        members = groups["_i_list"].combine_chunks()
        gid = np.empty(len(t), np.int64)
        gid[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), members.value_lengths().to_numpy())
        g, s, e = merge_sorted(gid, t["s"].to_numpy(), t["e"].to_numpy())
        starts, ends = _lists(g, s, e, len(groups))
        yield from pa.table([*[groups[k] for k in keys], starts, ends], names=[*keys, "starts", "ends"]).combine_chunks().to_batches()


def _merged(b: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """Rows of equal keys that follow each other become one row with disjoint lists."""
    new = np.ones(b.num_rows, bool)
    new[1:] = False
    for name in keys:
        c = b.column(name)
        new[1:] |= ~pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    s, e = b.column("starts"), b.column("ends")
    gid = np.repeat(np.cumsum(new) - 1, s.value_lengths().to_numpy())
    g, s2, e2 = merge_sorted(gid, s.flatten().to_numpy(), e.flatten().to_numpy())
    starts, ends = _lists(g, s2, e2, int(new.sum()))
    at = pa.array(np.flatnonzero(new))
    return pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], starts, ends], names=[*keys, "starts", "ends"])


def combine(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key out of rows with lists that may overlap (of partitions, days or loads): they come sorted by key
    and are merged as they come, so that a task holds one Arrow batch and one open list."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: pa.RecordBatch | None = None
        for batch in batches:
            for b in bounded_slices(batch, STEP):
                if not b.num_rows:
                    continue
                if opened is not None:
                    b = pa.Table.from_batches([opened, b]).combine_chunks().to_batches()[0]
                done = _merged(b, keys)
                opened = done.slice(done.num_rows - 1)
                if done.num_rows > 1:
                    yield done.slice(0, done.num_rows - 1)
        if opened is not None:
            yield opened

    rows = lists.select(*keys, "starts", "ends").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, rows.schema)


def disjoint_lists(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int | None = None) -> DataFrame:
    """The aggregate: keys, tile, starts, ends (sorted, disjoint within the tile of their start).

    Without ``tile`` its width comes from the observed range (one pass over the starts), so that an entity has at most
    TILES tiles in any unit. Aggregates that are to be merged need the same tile.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    for k in [*keys, "s", "e"]:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.where(F.col("e") > F.col("s"))
    if tile is None:
        low, high = rows.agg(F.min("s"), F.max("s")).first()
        tile = max(TILE, ((high or 0) - (low or 0)) // TILES + 1)
    rows = rows.select(*keys, F.expr(f"(s - pmod(s, {int(tile)})) div {int(tile)}").alias("tile"), "s", "e")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]) + ", starts array<bigint>, ends array<bigint>"
    return combine(rows.mapInArrow(_partial, schema), [*keys, "tile"])


def merge_lists(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two aggregates of the same tile (of other days or loads) into one."""
    return combine(a.unionByName(b), [*keys, "tile"])


def periods_and_gaps(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind (``period`` or ``gap``), start0, end0 of an aggregate."""
    keys = list(keys)
    lists = materialize(lists)
    before = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = lists.select(*keys, "tile", F.array_max("ends").alias("_top")).withColumn("_carry", F.max("_top").over(before)).drop("_top")
    t = lists.join(carry, [*keys, "tile"])
    n_old = F.size(F.filter("starts", lambda x: x <= F.col("_carry")))
    t = t.withColumn("_n_old", F.when(F.col("_carry").isNull(), 0).otherwise(n_old)).withColumn("_n", F.size("starts"))
    t = t.withColumn("_head", F.greatest("_carry", F.when(F.col("_n_old") > 0, F.element_at("ends", F.col("_n_old")))))
    pairs = F.arrays_zip(F.col("starts").alias("start0"), F.col("ends").alias("end0"))
    new = F.slice(pairs, F.col("_n_old") + 1, F.greatest(F.col("_n") - F.col("_n_old"), F.lit(0)))
    t = t.withColumn("_new", new).withColumn("_k", F.size("_new"))

    inner = F.slice("_new", 1, F.greatest(F.col("_k") - 1, F.lit(0)))
    whole = t.select(*keys, F.inline(inner)).withColumn("kind", F.lit("period"))

    prev_end = F.concat(F.array("_head"), F.transform("_new", lambda p: p["end0"]))
    gap = F.filter(F.transform("_new", lambda p, i: F.struct(F.get(prev_end, i).alias("start0"), p["start0"].alias("end0"))), lambda g: g["start0"].isNotNull())
    gaps = t.select(*keys, F.inline(gap)).withColumn("kind", F.lit("gap"))

    old = F.when(F.col("_n_old") > 0, F.struct(F.element_at("starts", 1).alias("start0"), F.element_at("ends", F.col("_n_old")).alias("end0")))
    tail = F.when(F.col("_k") > 0, F.element_at("_new", -1))
    ends = t.select(*keys, F.inline(F.array_compact(F.array(old, tail))))
    w = Window.partitionBy(*keys).orderBy("start0", "end0")
    reach = F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_fresh", (reach.isNull() | (F.col("start0") > reach)).cast("int")).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ends.groupBy(*keys, "_island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("_island").withColumn("kind", F.lit("period"))
    return whole.unionByName(joined).unionByName(gaps).select(*keys, "kind", "start0", "end0")
