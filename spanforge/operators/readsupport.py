"""From reads to read support: one row per variant, allele class and read becomes one row per variant and allele class.

Defined results: null statistics are no values; reads without an allele class give no support; a group without values has
null statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.distributions import binom_test


def summarize(df: DataFrame, keys: Sequence[str], allele: str, stats: Sequence[str], clip: str | None = None, orient: str | None = None) -> DataFrame:
    """keys, allele, n, mean, median and deviation of each statistic, reads with clipped bases, reads by orientation."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for s in stats:
        v = F.col(s).cast("double")
        aggs += [F.avg(v).alias(f"mean_{s}"), F.median(v).alias(f"median_{s}"), F.stddev_pop(v).alias(f"std_{s}")]
    if clip:
        aggs.append(F.count_if(F.col(clip) > 0).alias("clipped"))
    if orient:
        aggs += [F.count_if(F.col(orient) == o).alias(o) for o in ("f1r2", "f2r1")]
    return df.where(F.col(allele).isNotNull()).groupBy(*keys, allele).agg(*aggs)


def as_map(df: DataFrame, keys: Sequence[str], allele: str, value: str, name: str) -> DataFrame:
    """keys, ``name``: map of allele class to a value."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(allele, value)))).alias(name))


def uniform_pvalues(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, p_value: Kolmogorov-Smirnov test of places in reads (parts of 1) against the uniform distribution, by the limit
    distribution. Values are counted in steps of a thousandth first, so a group has at most 1,001 rows, whatever its size."""
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v))
    step = F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 1000)
    t = known.groupBy(*keys, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    t = t.withColumns({"_total": F.sum("_n").over(w), "_upto": F.sum("_n").over(w.orderBy("_step"))})
    x = F.col("_step") / 1000
    gap = F.greatest(F.col("_upto") / F.col("_total") - x, x - (F.col("_upto") - F.col("_n")) / F.col("_total"))
    d = t.groupBy(*keys).agg(F.max(gap).alias("_d"), F.sqrt(F.max("_total")).alias("_s"))
    z = (F.col("_s") + 0.12 + F.lit(0.11) / F.col("_s")) * F.col("_d")
    d = d.withColumn("_z", z)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(j * j * F.col("_z") * F.col("_z") * -2.0))
    p = F.aggregate(terms, F.lit(0.0), lambda acc, y: acc + y)
    return d.select(*keys, F.when(F.col("_z") < 0.2, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).alias("p_value"))


def orientation_balance(a: Column, b: Column) -> Column:
    """Two-sided probability of the balance of two counts of orientations."""

    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(i) or pd.isna(j) or i + j == 0 else binom_test(int(i), int(i + j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(test, "double")(a, b)


def recurrent_mismatches(df: DataFrame, keys: Sequence[str], read: str, mismatch: str, spans: DataFrame, fraction: float = 0.9, least: int = 3) -> DataFrame:
    """Adds ``recurrent``: whether a mismatch is carried by at least ``fraction`` of the reads that span it, of which there
    are at least ``least``. spans: keys, mismatch, n_span."""
    n = df.groupBy(*keys, mismatch).agg(F.count_distinct(read).alias("_n"))
    t = n.join(spans, [*keys, mismatch], "left")
    flag = t.select(*keys, mismatch, ((F.col("n_span") >= least) & (F.col("_n") / F.col("n_span") >= fraction)).alias("recurrent"))
    return df.join(flag, [*keys, mismatch], "left").withColumn("recurrent", F.coalesce("recurrent", F.lit(False)))


def doublets(df: DataFrame, keys: Sequence[str], pos: str = "POS", ref: str = "REF", alt: str = "ALT1") -> DataFrame:
    """keys, pos, ref, alt of substitutions of neighbouring bases taken together in pairs, from the left; each belongs to one."""
    w = Window.partitionBy(*keys).orderBy(pos)
    t = df.select(*keys, pos, ref, alt).dropDuplicates([*keys, pos]).withColumn("_run", F.col(pos) - F.row_number().over(w))
    r = Window.partitionBy(*keys, "_run").orderBy(pos)
    t = t.withColumns({"_i": F.row_number().over(r), "_r2": F.lead(ref).over(r), "_a2": F.lead(alt).over(r)})
    return t.where((F.col("_i") % 2 == 1) & F.col("_r2").isNotNull()).select(*keys, pos, F.concat(ref, "_r2").alias("ref"), F.concat(alt, "_a2").alias("alt"))


def cpg_pairs(df: DataFrame) -> DataFrame:
    """Chromosome, pos, both, methylated, total of per-strand CpG counts (Chromosome, pos, base, methylated, unmethylated): a C
    and the G behind it become one row; others stand alone."""
    w = Window.partitionBy("Chromosome").orderBy("pos")
    t = df.withColumns({"_p": F.lead("pos").over(w), "_b": F.lead("base").over(w), "_m": F.lead("methylated").over(w), "_u": F.lead("unmethylated").over(w), "_q": F.lag("pos").over(w), "_c": F.lag("base").over(w)})
    pair = (F.col("base") == "C") & (F.col("_b") == "G") & (F.col("_p") == F.col("pos") + 1)
    second = (F.col("base") == "G") & (F.col("_c") == "C") & (F.col("_q") == F.col("pos") - 1)
    t = t.where(~F.coalesce(second, F.lit(False))).withColumn("both", F.coalesce(pair, F.lit(False)))
    m = F.col("methylated") + F.when(F.col("both"), F.col("_m")).otherwise(0)
    u = F.col("unmethylated") + F.when(F.col("both"), F.col("_u")).otherwise(0)
    pos = F.when(~F.col("both") & (F.col("base") == "G"), F.col("pos") - 1).otherwise(F.col("pos"))
    return t.select("Chromosome", pos.alias("pos"), "both", m.alias("methylated"), (m + u).alias("total"))
