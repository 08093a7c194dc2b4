"""Groups of reads: pairs by name, clipped ends by place with their consensus, mismatches against the reference.

Defined results: null sequences are no reads; a consensus is as long as the longest sequence, a place counts those that reach
it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, name: str, first: str, pos: str) -> DataFrame:
    """name, n, paired, Start, End: reads of one name and whether each mate is there once."""
    one = (F.count_if(F.col(first)) == 1) & (F.count_if(~F.col(first)) == 1)
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), one.alias("paired"), F.min(pos).alias("Start"), F.max(pos).alias("End"))


def clip_consensus(df: DataFrame, keys: Sequence[str], seq: str, more_than: int = 1, threshold: float = 0.5, ambiguous: str = "X") -> DataFrame:
    """keys, n, ``seq``: places with more than so many clipped reads, and the base that most of them have at each place. Bases
    are counted per place of the clip, so no group is collected."""
    t = df.where(F.col(seq).isNotNull())
    n = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    b = t.select(*keys, F.posexplode(F.split(seq, "")).alias("_i", "_b")).where(F.col("_b") != "").groupBy(*keys, "_i", "_b").agg(F.count(F.lit(1)).alias("_k"))
    best = b.withColumn("_t", F.sum("_k").over(Window.partitionBy(*keys, "_i"))).groupBy(*keys, "_i").agg(F.max_by(F.struct("_b", "_k", "_t"), F.struct("_k", "_b")).alias("x"))
    base = F.when(F.col("x._k") / F.col("x._t") > threshold, F.col("x._b")).otherwise(ambiguous)
    text = best.select(*keys, "_i", base.alias("_c")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]), "").alias(seq))
    return n.join(text, list(keys))


def mismatches(read: Column, ref: Column, pos0: Column) -> Column:
    """Array of struct(pos0, ref, read) of the places where two aligned sequences of one length differ."""
    at = lambda s, i: F.substr(s, (i + 1).cast("int"), F.lit(1))
    n = F.least(F.length(read), F.length(ref))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((pos0 + i).alias("pos0"), at(ref, i).alias("ref"), at(read, i).alias("read")))
    return F.when(n > 0, F.filter(each, lambda x: x["ref"] != x["read"]))
