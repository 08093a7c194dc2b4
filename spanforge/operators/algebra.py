"""Set algebra of interval frames (see ``frames``): merging, clustering, intersections, differences, tiles and gaps.

Defined results: rows with a null in a coordinate or an end not after the start cover nothing and are left out; the
difference keeps repeated left rows as often as they come; results that are sets have no order and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.frames import COORDS, annots
from spanforge.operators.interval_periods import disjoint_lists, periods_and_gaps
from spanforge.operators.ordered import Run, running, running_all
from spanforge.operators.overlap_join import _valid, overlap_pairs
from spanforge.runtime import materialize


def merge(df: DataFrame) -> DataFrame:
    """The union of overlapping or touching rows."""
    t = periods_and_gaps(disjoint_lists(df, ["Chromosome"], "Start", "End"), ["Chromosome"]).where(F.col("kind") == "period")
    return t.select("Chromosome", F.col("start0").alias("Start"), F.col("end0").alias("End"))


def gaps(df: DataFrame) -> DataFrame:
    """The space between successive merged rows."""
    t = periods_and_gaps(disjoint_lists(df, ["Chromosome"], "Start", "End"), ["Chromosome"]).where(F.col("kind") == "gap")
    return t.select("Chromosome", F.col("start0").alias("Start"), F.col("end0").alias("End"))


def cluster(df: DataFrame, slack: int = 0) -> DataFrame:
    """Adds Cluster: the number (from 1, per contig) of the group of overlapping or touching rows, or of rows with gaps of
    at most ``slack``."""
    t = running(_valid(df), ["Chromosome"], F.col("End"), "max", "_top")
    new = F.coalesce(F.col("Start") > F.col("_top") + slack, F.lit(True)).cast("long")
    # of equal rows the one that opens a group comes first
    t = running(materialize(t.withColumn("_new", new).withColumn("_old", 1 - F.col("_new"))), ["Chromosome"], F.col("_new"), "sum", "_groups", order=("Start", "End", "_old"))
    return t.select(*df.columns, (F.coalesce("_groups", F.lit(0)) + F.col("_new")).alias("Cluster"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """The common part of every overlapping pair, with the annotations of the left row."""
    t = overlap_pairs(left, right.select(*COORDS))
    return t.select("Chromosome", F.greatest("Start", "Start_b").alias("Start"), F.least("End", "End_b").alias("End"), *annots(left))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pieces of left rows that no right row covers, with annotations."""
    cols = left.columns
    rows = _valid(left).groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    hits = overlap_pairs(rows, merge(right))
    w = Window.partitionBy(*cols).orderBy("Start_b")
    after = hits.select(*cols, "_copies", F.col("End_b").alias("_s"), F.coalesce(F.lead("Start_b").over(w), F.col("End")).alias("_e"))
    first = hits.groupBy(*cols, "_copies").agg(F.min("Start_b").alias("_e")).select(*cols, "_copies", F.col("Start").alias("_s"), "_e")
    same = F.lit(True)
    touched = hits.select(*[F.col(c).alias(f"_t_{c}") for c in cols]).distinct()
    for c in cols:
        same &= rows[c].eqNullSafe(touched[f"_t_{c}"])
    whole = rows.join(touched, same, "left_anti").select(*cols, "_copies", F.col("Start").alias("_s"), F.col("End").alias("_e"))
    pieces = after.unionByName(first).unionByName(whole).where(F.col("_e") > F.col("_s"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i"))
    return pieces.select("Chromosome", F.col("_s").alias("Start"), F.col("_e").alias("End"), *annots(left))


def set_union(*frames: DataFrame) -> DataFrame:
    t = frames[0].select(*COORDS)
    for f in frames[1:]:
        t = t.unionByName(f.select(*COORDS))
    return merge(t)


def set_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return intersect(merge(left), merge(right))


def isec_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Disjoint refinement of two frames without overlaps of their own: common parts and both differences, with in_left
    and in_right. A sweep over the borders of both: how many rows are open behind each, and where the next one is."""

    def borders(df: DataFrame, in_left: int, in_right: int) -> DataFrame:
        ends = F.array(F.struct(F.col("Start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("End").alias("pos"), F.lit(-1).alias("d")))
        return _valid(df).select("Chromosome", F.explode(ends).alias("x")).select("Chromosome", "x.pos", (F.col("x.d") * in_left).alias("l"), (F.col("x.d") * in_right).alias("r"))

    t = borders(left, 1, 0).unionByName(borders(right, 0, 1)).groupBy("Chromosome", "pos").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    runs = [Run("_l", F.col("l"), "sum"), Run("_r", F.col("r"), "sum"), Run("_next", F.col("pos"), "min", reverse=True)]
    t = running_all(t, ["Chromosome"], runs, "pos", ("pos",))
    inside = [(F.coalesce(f"_{side}", F.lit(0)) + F.col(side) > 0) for side in "lr"]
    t = t.select("Chromosome", F.col("pos").alias("Start"), F.col("_next").alias("End"), inside[0].alias("in_left"), inside[1].alias("in_right"))
    return t.where(F.col("End").isNotNull() & (F.col("in_left") | F.col("in_right")))


def concat(*frames: DataFrame) -> DataFrame:
    t = frames[0]
    for f in frames[1:]:
        t = t.unionByName(f, allowMissingColumns=True)
    return t


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds NumberOverlaps and FractionOverlaps, the covered part of each row."""
    a = _valid(left.select(*COORDS)).distinct()
    n = overlap_pairs(a, right.select(*COORDS)).groupBy(*COORDS).agg(F.count(F.lit(1)).alias("_n"))
    part = F.sum(F.least("End", "End_b") - F.greatest("Start", "Start_b"))
    covered = overlap_pairs(a, merge(right)).groupBy(*COORDS).agg(part.alias("_c"))
    t = left.join(n, list(COORDS), "left").join(covered, list(COORDS), "left")
    return t.select(*left.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("NumberOverlaps"), (F.coalesce("_c", F.lit(0)) / (F.col("End") - F.col("Start"))).alias("FractionOverlaps"))


def slop(df: DataFrame, contigs: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Rows extended to both sides, within their contig."""
    t = df.join(contigs.select("Chromosome", F.col("length").alias("_length")), "Chromosome", "left")
    return t.select("Chromosome", F.greatest(F.col("Start") - left, F.lit(0)).alias("Start"), F.least(F.col("End") + right, F.col("_length")).alias("End"), *annots(df))


def window(df: DataFrame, width: int) -> DataFrame:
    """Each row cut into windows of ``width`` from its own start, the last one being shorter."""
    t = _valid(df).withColumn("_s", F.explode(F.sequence(F.col("Start"), F.col("End") - 1, F.lit(width).cast("long"))))
    return t.select("Chromosome", F.col("_s").alias("Start"), F.least("End", F.col("_s") + width).alias("End"), *annots(df))


def tile(df: DataFrame, width: int) -> DataFrame:
    """Each row cut at the multiples of ``width``."""
    t = _valid(df).withColumn("_t", F.explode(F.sequence(F.floor(F.col("Start") / width), F.floor((F.col("End") - 1) / width))))
    return t.select("Chromosome", F.greatest("Start", F.col("_t") * width).alias("Start"), F.least("End", (F.col("_t") + 1) * width).alias("End"), *annots(df))


def depth_bins(contigs: DataFrame, width: int) -> DataFrame:
    """Contigs cut into near-equal bins of about ``width``: the remainder is spread over the leading bins."""
    n = F.greatest(F.floor(F.col("length") / width), F.lit(1))
    t = contigs.select("Chromosome", "length", n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    base, more = F.floor(F.col("length") / F.col("n")), F.col("length") % F.col("n")
    start = F.col("i") * base + F.least("i", more)
    return t.select("Chromosome", start.alias("Start"), (start + base + (F.col("i") < more).cast("long")).alias("End"))


def fill_gaps(df: DataFrame, contigs: DataFrame, edit_ends: bool = True) -> DataFrame:
    """Rows without overlaps, drawn out so that they touch: a border moves to the middle of a gap, rounded down; the first
    and last border of a contig to its ends (unless ``edit_ends`` is off)."""
    t = running_all(_valid(df), ["Chromosome"], [Run("_prev", F.col("End"), "max"), Run("_next", F.col("Start"), "min", reverse=True)])
    t = t.join(contigs.select("Chromosome", F.col("length").alias("_length")), "Chromosome", "left")
    lo = F.floor((F.col("_prev") + F.col("Start")) / 2)
    hi = F.floor((F.col("End") + F.col("_next")) / 2)
    first, last = (F.lit(0), F.col("_length")) if edit_ends else (F.col("Start"), F.col("End"))
    return t.select("Chromosome", F.coalesce(lo, first).cast("long").alias("Start"), F.coalesce(hi, last).cast("long").alias("End"), *annots(df))


# ---- ranges ----


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Size of the gap between two ranges; 0 if they overlap or touch."""
    return F.greatest(F.lit(0).cast("long"), s2 - e1, s1 - e2)


def common_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(e1, e2) - F.greatest(s1, s2))


def range_intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(start, end), null if the ranges have nothing in common."""
    lo, hi = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(lo < hi, F.struct(lo.alias("start"), hi.alias("end")))


def range_subtraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The up to two pieces of the first range that the second does not cover, as an array of struct(start, end)."""
    lo, hi = F.least(e1, F.greatest(s1, s2)), F.greatest(s1, F.least(e1, e2))
    apart = (s2 >= e1) | (s1 >= e2)
    pieces = F.filter(F.array(F.struct(s1.alias("start"), lo.alias("end")), F.struct(hi.alias("start"), e1.alias("end"))), lambda x: x["start"] < x["end"])
    return F.when(apart, F.array(F.struct(s1.alias("start"), e1.alias("end")))).otherwise(pieces)


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def spans(query_start: Column, query_end: Column, start: Column, end: Column) -> Column:
    """Whether the query covers the target."""
    return (query_start <= start) & (query_end >= end)
