"""Joins and set operations of tables of variants on their identity.

Defined results: null alternatives equal each other, so a variant with one alternative equals only such a one; copies within
a table stay copies in joins and are one variant in set operations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[prefix + k]) for k in keys])


def join(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "left") -> DataFrame:
    """Frames joined one after the other on identity; other columns must have different names. how: left, inner, full."""
    out = frames[0]
    for f in frames[1:]:
        b = f.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in f.columns if c not in keys])
        rest = [c for c in out.columns if c not in keys]
        # a row without a match has nulls in all keys, which coalesce takes from the other side
        t = out.withColumn("_here", F.lit(True)).join(b, _same(out, b, keys, "_"), how)
        out = t.select(*[F.when(F.col("_here"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], *rest, *[c for c in f.columns if c not in keys])
    return out


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose variant is in ``b``."""
    k = b.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    return a.join(k, _same(a, k, keys, "_"), "left_semi")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = b.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    return a.join(k, _same(a, k, keys, "_"), "left_anti")


def combine(files: Mapping[str, DataFrame], keys: Sequence[str], wanted: Mapping[str, bool]) -> DataFrame:
    """Each variant of any file once: keys, sources (names of the files that have it), isec: whether it lies in all files
    that ``wanted`` flags and in none of the others. One shuffle, whatever the number of files."""
    tall = reduce(DataFrame.unionByName, [f.select(*keys, F.lit(name).alias("_src")) for name, f in files.items()])
    t = tall.groupBy(*keys).agg(F.sort_array(F.collect_set("_src")).alias("sources"))
    rule = reduce(lambda a, b: a & b, [F.array_contains("sources", n) if yes else ~F.array_contains("sources", n) for n, yes in wanted.items()])
    return t.select(*keys, rule.alias("isec"), "sources")
