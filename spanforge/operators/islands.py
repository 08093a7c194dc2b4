"""Runs of neighbouring rows: merging by annotation, wider bins, segments with little data, run-length groups.

Order is that of Start and End per contig, kept by tiles (see ``ordered``). Defined results: null annotations equal each
other; a frame without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.frames import COORDS
from spanforge.operators.ordered import Run, running, running_all
from spanforge.runtime import materialize


def run_groups(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("Chromosome",), pos: str = "Start", order: Sequence[str] = ("Start", "End"), name: str = "run") -> DataFrame:
    """Adds the number (from 1, per key) of the run of equal values that a row belongs to."""
    here = F.struct(*[F.col(c) for c in order], F.struct(*values).alias("_x"))
    t = running(df, keys, here, "max", "_prev", pos, order)
    new = (~F.coalesce(F.struct(*values).eqNullSafe(F.col("_prev._x")), F.lit(False))).cast("long")
    t = running(materialize(t.select(*df.columns, new.alias("_new"))), keys, F.col("_new"), "sum", "_runs", pos, order)
    return t.select(*df.columns, (F.coalesce("_runs", F.lit(0)) + F.col("_new")).alias(name))


def merge_byannot(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Neighbouring rows with equal annotations become one, from the first start to the last end; gaps are bridged."""
    t = run_groups(df, values)
    return t.groupBy("Chromosome", "run").agg(F.min("Start").alias("Start"), F.max_by("End", F.struct("Start", "End")).alias("End"), *[F.first(c).alias(c) for c in values]).select(*COORDS, *values)


def binsize(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: the width that all bins but the last of each contig have, null if there is none or a last one is wider."""
    size = F.col("End") - F.col("Start")
    t = df.join(contigs.select("Chromosome", "length"), "Chromosome").withColumn("last", F.col("End") == F.col("length"))
    return t.agg(
        F.min(F.when(~F.col("last"), size)).alias("lo"), F.max(F.when(~F.col("last"), size)).alias("hi"), F.max(F.when(F.col("last"), size)).alias("end")
    ).select(F.when((F.col("lo") == F.col("hi")) & (F.coalesce("end", F.lit(0)) <= F.col("lo")), F.col("lo")).alias("binsize"))


def upsize_bin(df: DataFrame, contigs: DataFrame, old: int, new: int, numeric: Sequence[str] = (), boolean: Sequence[str] = (), merge_bool: str = "any") -> DataFrame:
    """Bins of width ``old`` that tile the contigs, gathered into bins of width ``new``: mean of numbers, any or all of
    booleans. Old bin i belongs to the first new bin j with int(new * (j + 1) / old) > i; the last ends with its contig."""
    i = F.floor(F.col("Start") / old)
    j = F.floor(i * old / new)
    # rounding down of the borders: an old bin that begins in j may belong to the next one
    j = F.when(F.floor(F.lit(new) * (j + 1) / F.lit(old)) > i, j).otherwise(j + 1)
    t = df.join(contigs.select("Chromosome", F.col("length").alias("_length")), "Chromosome")
    top = F.ceil(F.col("_length") / new) - 1
    flag = F.bool_or if merge_bool == "any" else F.bool_and
    aggs = [F.avg(c).alias(c) for c in numeric] + [flag(c).alias(c) for c in boolean]
    g = t.groupBy("Chromosome", "_length", F.least(j, top).alias("_j")).agg(*aggs)
    return g.select("Chromosome", (F.col("_j") * new).cast("long").alias("Start"), F.least((F.col("_j") + 1) * new, F.col("_length")).cast("long").alias("End"), *numeric, *boolean)


def merge_low(df: DataFrame, ndata: str, cutoff: int = 30) -> DataFrame:
    """Runs of segments with less data than ``cutoff`` become one; the others stay."""
    t = df.select(*COORDS, (F.coalesce(F.col(ndata), F.lit(0)) < cutoff).alias("low")).withColumn("own", F.when(~F.col("low"), F.col("Start")))
    t = run_groups(t, ["low", "own"])
    return t.groupBy("Chromosome", "run").agg(F.min("Start").alias("Start"), F.max("End").alias("End")).select(*COORDS)


def incorporate_low(df: DataFrame, contigs: DataFrame, ndata: str, cutoff: int = 30) -> DataFrame:
    """Segments of less data than ``cutoff`` (no two in a row, see ``merge_low``) go to their neighbours: those at an end of
    a contig to the one neighbour, which then reaches the end; others are halved at their middle."""
    t = df.select(*COORDS, (F.coalesce(F.col(ndata), F.lit(0)) < cutoff).alias("low"))
    at = F.struct("Start", "End", "low")
    high = F.when(~F.col("low"), F.col("Start"))
    runs = [Run("_prev", at, "max"), Run("_next", at, "min", reverse=True), Run("_high_before", high, "max"), Run("_high_after", high, "min", reverse=True)]
    t = running_all(t, ["Chromosome"], runs)
    t = t.join(contigs.select("Chromosome", F.col("length").alias("_length")), "Chromosome", "left")

    def middle(s: str) -> Column:
        return F.floor((F.col(f"{s}.Start") + F.col(f"{s}.End") - 1) / 2)

    start = F.when(F.col("_prev.low"), F.when(F.col("_high_before").isNull(), F.lit(0)).otherwise(middle("_prev"))).otherwise(F.col("Start"))
    end = F.when(F.col("_next.low"), F.when(F.col("_high_after").isNull(), F.col("_length")).otherwise(middle("_next"))).otherwise(F.col("End"))
    return t.where(~F.col("low")).select("Chromosome", start.cast("long").alias("Start"), end.cast("long").alias("End"))


def first_of_clusters(df: DataFrame) -> DataFrame:
    """The first row of every group of overlapping or touching rows."""
    t = running(df, ["Chromosome"], F.col("End"), "max", "_top")
    return t.where(F.col("_top").isNull() | (F.col("Start") > F.col("_top"))).select(*df.columns)
