"""Percentiles of very large numeric columns per group, with bounded error and mergeable state.

Values are quantized to a bounded ordered universe: steps of ``resolution`` up to ``2**LINEAR_BITS`` of them, beyond
that steps of a relative width of ``2**-LINEAR_BITS`` (so every finite double has a code, negative ones too). A digest
holds counts at nodes of the dyadic tree over the universe. A node and its sibling move into their parent where all
three hold at most n/k together, so an inner node never holds more than n/k and a rank is off by at most
``HEIGHT * n/k <= eps * n``; a digest has at most 3k nodes. Digests are merged by adding counts node by node, which
keeps the bound, whatever the order: partitions, days and loads combine.

Every input partition builds its own digests (one more for every FLUSH rows). They are merged in two levels, first the
partitions of one salt, then the SALTS of a group; at each level the digests of a group are added up one after the
other, so that a task holds few of them however many rows, partitions or digests a group has.

Defined results: null and NaN are no values, nor are infinities; a group without values has no row; null group keys
form a group; groups of at most k values are exact up to quantization; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import bounded_slices

LINEAR_BITS = 20
#: Height of the tree: codes stay below 2**30 in size for all doubles, and carry a sign.
HEIGHT = 31
EPS = 0.005
#: Digests of one group that the second level of merging gets; rows after which a partition closes a digest; bytes that a
#: task adds up at once.
SALTS, FLUSH, STEP = 64, 500_000, 32 << 20
_M, _HALF = 1 << LINEAR_BITS, 1 << (LINEAR_BITS - 1)


def compression(eps: float = EPS) -> int:
    """k such that a rank is off by at most eps * n."""
    return math.ceil(HEIGHT / eps)


def leaf(value: Column, resolution: float) -> Column:
    """Place of a value in the ordered universe, 0 .. 2**HEIGHT - 1; null for what is no value."""
    v, step = value.cast("double"), F.lit(float(resolution))
    a, zero = F.abs(v), F.lit(1 << (HEIGHT - 1))
    # the logarithm of the quotient, not the quotient, which overflows for the largest doubles
    e = F.greatest(F.floor(F.log2(a) - F.lit(math.log2(resolution))) - F.lit(LINEAR_BITS - 1), F.lit(1)).cast("int")
    wide = F.lit(_M) + (e - 1) * F.lit(_HALF) + F.floor(a / F.pow(F.lit(2.0), e) / step) - F.lit(_HALF)
    near, none = a < (_M - 0.5) * resolution, F.isnan(v) | (a == float("inf"))
    return F.when(near, F.rint(v / step).cast("long") + zero).when(~none, F.when(v < 0, -wide).otherwise(wide) + zero)


def value_of(leaves: np.ndarray, resolution: float) -> np.ndarray:
    """The value that stands for each leaf (the middle of its step)."""
    c = leaves.astype(np.int64) - (1 << (HEIGHT - 1))
    a = np.abs(c)
    e = np.maximum((a - _M) // _HALF + 1, 1)
    wide = np.ldexp((((a - _M) % _HALF + _HALF).astype(float) + 0.5) * resolution, e)
    return np.sign(c) * np.where(a < _M, a.astype(float) * resolution, wide)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (group, node, count), sorted by group and node, after adding equal nodes and moving light ones upwards."""
    g, v, c = _add(group, node, count)
    if not len(g):
        return g, v, c
    size = np.zeros(int(g[-1]) + 1, np.int64)
    np.add.at(size, g, c)
    limit = size // k
    live = limit[g] > 0
    kept = [(g[~live], v[~live], c[~live])]
    g, v, c = g[live], v[live], c[live]
    for level in range(HEIGHT, 0, -1):
        if not len(g):
            break
        here = v >= 1 << level
        hg, hv, hc = g[here], v[here], c[here]
        g, v, c = g[~here], v[~here], c[~here]
        if not len(hg):
            continue
        # weight of each family: the two children, and the parent if it is there
        fg, fv, fc = _add(np.concatenate([hg, g]), np.concatenate([hv >> 1, v]), np.concatenate([hc, c]))
        at = np.searchsorted(_key(fg, fv), _key(hg, hv >> 1))
        up = fc[at] <= limit[hg]
        kept.append((hg[~up], hv[~up], hc[~up]))
        g, v, c = _add(np.concatenate([g, hg[up]]), np.concatenate([v, hv[up] >> 1]), np.concatenate([c, hc[up]]))
    kept.append((g, v, c))
    return _add(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _key(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    return g.astype(np.int64) << (HEIGHT + 1) | v


def _add(g: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(g):
        return g.astype(np.int64), v.astype(np.int64), c.astype(np.int64)
    key, inverse = np.unique(_key(g, v), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, c)
    return key >> (HEIGHT + 1), key & ((1 << (HEIGHT + 1)) - 1), total


def _rows(keys: pa.Table, g: np.ndarray, v: np.ndarray, c: np.ndarray, n: int) -> pa.Table:
    offsets = pa.array(np.searchsorted(g, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, c)]
    return pa.table([*keys.columns, *lists], names=[*keys.column_names, "nodes", "counts"])


def _numbered(t: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """(one row per distinct key, number of the key of each row)."""
    groups = t.append_column("_i", pa.array(np.arange(len(t)))).group_by(keys).aggregate([("_i", "list")])
    members = groups["_i_list"].combine_chunks()
    number = np.empty(len(t), np.int64)
    number[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), members.value_lengths().to_numpy())
    return groups.select(keys), number


def digests(df: DataFrame, keys: Sequence[str], leaves: str, eps: float = EPS) -> DataFrame:
    """keys, nodes, counts: the digest of each group of a column of leaves."""
    keys, k = list(keys), compression(eps)
    rows = df.select(*keys, F.col(leaves).cast("long").alias("_leaf")).where(F.col("_leaf").isNotNull())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(part)
            groups, number = _numbered(t, keys)
            yield from _rows(groups, *compress(number, t["_leaf"].to_numpy() + (1 << HEIGHT), np.ones(len(t), np.int64), k), n=len(groups)).combine_chunks().to_batches()

        part: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                part.append(b)
            if sum(x.num_rows for x in part) >= FLUSH:
                yield from flush(part)
                part = []
        if part:
            yield from flush(part)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", nodes array<bigint>, counts array<bigint>"
    out = rows.mapInArrow(build, schema).withColumn("_salt", F.spark_partition_id() % F.lit(SALTS))
    return merge(merge(out, [*keys, "_salt"], eps), keys, eps)


def merge(parts: DataFrame, keys: Sequence[str], eps: float = EPS) -> DataFrame:
    """One digest per key out of several: of partitions, days or loads.

    The digests of a key come one after the other and are added up as they come; a task holds what one Arrow batch
    brings, in steps of STEP bytes, and one digest that is still open.
    """
    keys, k = list(keys), compression(eps)
    rows = parts.select(*keys, "nodes", "counts").repartition(*keys).sortWithinPartitions(*keys) if keys else parts.select("nodes", "counts").coalesce(1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: pa.RecordBatch | None = None
        for batch in batches:
            for b in bounded_slices(batch, STEP):
                if not b.num_rows:
                    continue
                if opened is not None:
                    b = pa.Table.from_batches([opened, b]).combine_chunks().to_batches()[0]
                done = added(b)
                opened = done.slice(done.num_rows - 1)
                if done.num_rows > 1:
                    yield done.slice(0, done.num_rows - 1)
        if opened is not None:
            yield opened

    def added(b: pa.RecordBatch) -> pa.RecordBatch:
        new = np.ones(b.num_rows, bool)
        if keys:
            new[1:] = False
            for name in keys:
                c = b.column(name)
                same = pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                both = pc.and_(c.slice(1).is_null(), c.slice(0, len(c) - 1).is_null()).to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | both)
        else:
            new[1:] = False
        group = np.cumsum(new) - 1
        v, c = b.column("nodes"), b.column("counts")
        g = np.repeat(group, v.value_lengths().to_numpy())
        heads = pa.Table.from_batches([b]).select(keys).take(pa.array(np.flatnonzero(new))) if keys else pa.table({"_": [0]}).select([])
        out = _rows(heads, *compress(g, v.flatten().to_numpy(), c.flatten().to_numpy(), k), n=int(new.sum()))
        return out.combine_chunks().to_batches()[0]

    return rows.mapInArrow(add, rows.schema)


def query(nodes: np.ndarray, counts: np.ndarray, quantiles: Sequence[float]) -> np.ndarray:
    """Leaf at each quantile: the first, in order of the right ends, with which ceil(q*n) values are counted."""
    level = np.floor(np.log2(nodes.astype(float))).astype(np.int64)
    right = ((nodes + 1) << (HEIGHT - level)) - 1 - (1 << HEIGHT)
    order = np.lexsort((-level, right))
    total = np.cumsum(counts[order])
    wanted = np.maximum(np.ceil(np.asarray(quantiles) * total[-1] - 1e-9), 1)
    return right[order][np.searchsorted(total, wanted)]


def percentiles(digest: DataFrame, keys: Sequence[str], quantiles: dict[str, float], resolution: float, eps: float = EPS) -> DataFrame:
    """keys, n, a column per quantile (nearest rank), and rank_error, the most by which a rank can be off."""
    names, k = list(quantiles), compression(eps)

    def ask(nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = [value_of(query(v, c, list(quantiles.values())), resolution) for v, c in zip(nodes, counts, strict=True)]
        return pd.DataFrame(np.array(out).reshape(len(nodes), len(names)), columns=names)

    udf = F.pandas_udf(ask, ", ".join(f"`{n}` double" for n in names))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    t = digest.select(*keys, n.alias("n"), udf("nodes", "counts").alias("_q"))
    return t.select(*keys, "n", *[F.round(F.col("_q")[x], 9).alias(x) for x in names], (F.floor(F.col("n") / F.lit(k)) * F.lit(HEIGHT)).alias("rank_error"))
