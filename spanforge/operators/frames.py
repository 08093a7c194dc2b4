"""Interval frames: tables with Chromosome, Start and End (0-based, half-open) and any further columns (annotations).

Defined results: nulls in a coordinate satisfy no predicate on it and no overlap; empty frames give empty results; rows
that occur several times stay that often unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.ordered import numbered, running

COORDS = ("Chromosome", "Start", "End")
#: Fixed value: names of assembled contigs.
ASSEMBLED = r"(?i)^(chr)?(0*[1-9][0-9]*|[XY])$"


def annots(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in COORDS]


def contig_table(chromdict: DataFrame, name: str = "chrom") -> DataFrame:
    """Chromosome, length, idx, cum_start of a contig dictionary (chrom, chr_name, length, idx, cum_start). A fixed small
    dimension: a few dozen to some thousand contigs, so it is broadcast by its statistics."""
    return chromdict.select(F.col(name).alias("Chromosome"), "length", "idx", "cum_start").where(F.col("Chromosome").isNotNull())


# ---- sources ----


def from_records(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of equal width as a frame; another width is an error."""
    return spark.createDataFrame(list(rows), schema)


def init_empty(spark: SparkSession, annotations: str = "") -> DataFrame:
    return spark.createDataFrame([], "Chromosome string, Start bigint, End bigint" + (f", {annotations}" if annotations else ""))


def from_data(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Missing starts become 0 and missing ends the length of the contig."""
    have = set(df.columns)
    for c in ("Start", "End"):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("long"))
    rest = annots(df)
    t = df.join(contigs.select("Chromosome", F.col("length").alias("_length")), "Chromosome", "left")
    return t.select("Chromosome", F.coalesce("Start", F.lit(0)).cast("long").alias("Start"), F.coalesce("End", "_length").cast("long").alias("End"), *rest)


def all_regions(contigs: DataFrame, assembled_only: bool = True) -> DataFrame:
    """One row per contig, [0, length)."""
    t = contigs.where(is_assembled(F.col("Chromosome"))) if assembled_only else contigs
    return t.select("Chromosome", F.lit(0).cast("long").alias("Start"), F.col("length").alias("End"))


def from_margins(contigs: DataFrame, left: str, start: int, right: str, end: int) -> DataFrame:
    """The regions from (left, start) to (right, end) over the contigs between, in contig order; an end that is not
    behind the start is an error."""
    at = {r["Chromosome"]: (r["idx"], r["cum_start"]) for r in contigs.where(F.col("Chromosome").isin(left, right)).collect()}
    if at[left][1] + start >= at[right][1] + end:
        raise ValueError("the right margin is not behind the left one")
    t = contigs.where(F.col("idx").between(at[left][0], at[right][0]))
    return t.select("Chromosome", F.when(F.col("Chromosome") == left, F.lit(start)).otherwise(0).cast("long").alias("Start"), F.when(F.col("Chromosome") == right, F.lit(end)).otherwise(F.col("length")).cast("long").alias("End"))


# ---- projections ----


def choose_annots(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*COORDS, *names)


def drop_annots(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Without some annotations (all, if None); coordinates stay, unknown names are ignored."""
    return df.drop(*[c for c in (annots(df) if names is None else names) if c not in COORDS])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def add_affix(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Annotations, not coordinates, with a prefix and suffix."""
    return df.select(*COORDS, *[F.col(c).alias(f"{prefix}{c}{suffix}") for c in annots(df)])


def midpoint() -> Column:
    return F.floor((F.col("Start") + F.col("End") - 1) / 2)


def length() -> Column:
    return F.col("End") - F.col("Start")


def with_contig(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds contig_length, contig_idx and cum_start; unknown contigs get nulls."""
    return df.join(contigs.select("Chromosome", F.col("length").alias("contig_length"), F.col("idx").alias("contig_idx"), "cum_start"), "Chromosome", "left")


# ---- filters ----


def is_assembled(chrom: Column) -> Column:
    return chrom.rlike(ASSEMBLED)


def overlaps(chrom: str, start: int | None = None, end: int | None = None) -> Column:
    """Whether a row overlaps the range; an end that is None is open."""
    c = F.col("Chromosome") == chrom
    if end is not None:
        c &= F.col("Start") < end
    if start is not None:
        c &= F.col("End") > start
    return c


def subset_chroms(df: DataFrame, chroms: Sequence[str], drop: bool = False) -> DataFrame:
    hit = F.col("Chromosome").isin(list(chroms))
    return df.where(~hit if drop else hit)


def in_range(value: Column, low: float | None, high: float | None, include: bool = False) -> Column:
    """Range predicate, exclusive unless ``include``; a bound that is None is open. Null and NaN are in no range."""
    ok = value.isNotNull() & ~F.isnan(value.cast("double"))
    if low is not None:
        ok &= (value >= low) if include else (value > low)
    if high is not None:
        ok &= (value <= high) if include else (value < high)
    return F.coalesce(ok, F.lit(False))


def violations(df: DataFrame) -> DataFrame:
    """Rows that are no valid intervals, with the first reason that applies."""
    reason = F.when(F.col("Chromosome").isNull() | F.col("Start").isNull() | F.col("End").isNull(), "null").when(F.col("Start") < 0, "negative start").when(F.col("End") <= F.col("Start"), "end not after start")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


# ---- order ----


def sort(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """By contig order (not by name), start and end; rows on unknown contigs last."""
    t = with_contig(df, contigs).orderBy(F.col("contig_idx").asc_nulls_last(), "Chromosome", "Start", "End")
    return t.select(*df.columns)


def frame_rows(df: DataFrame, contigs: DataFrame, name: str = "row") -> DataFrame:
    """The number of each row, from 0, in frame order; rows of equal coordinates in any order."""
    t = with_contig(df, contigs)
    return numbered(t, [F.col("contig_idx").asc_nulls_last(), F.col("Start"), F.col("End")], name).select(*df.columns, name)


def chunk(row: Column, total: int, n: int) -> Column:
    """Number of the chunk (from 0) of a row if ``total`` rows are split into n chunks, of which the first are longer by one."""
    q, r = divmod(total, n)
    return F.when(row < r * (q + 1), F.floor(row / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((row - r * (q + 1)) / F.lit(max(q, 1)))).cast("long")


def equal_nrow_split(df: DataFrame, contigs: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """Adds ``chunk``: n near-equal runs of rows in frame order (or as many as keep them within ``width`` rows)."""
    t = frame_rows(df, contigs)
    total = t.count()
    n = n or max(1, -(-total // width))
    return t.select(*df.columns, chunk(F.col("row"), total, n).alias("chunk"))


def equal_length_split(df: DataFrame, contigs: DataFrame, n: int) -> DataFrame:
    """The intervals cut into pieces that belong to n parts of near-equal total length, with ``part`` (from 0)."""
    t = cumulative(df, contigs).withColumn("_from", F.col("length_cumsum") - (F.col("End") - F.col("Start")))
    total = t.agg(F.sum(F.col("End") - F.col("Start"))).first()[0] or 0
    q, r = divmod(total, n)

    def part_of(offset: Column) -> Column:
        return chunk(offset, total, n)

    def begin(p: Column) -> Column:
        return (p * F.lit(q) + F.least(p, F.lit(r))).cast("long")

    p = F.explode(F.sequence(part_of(F.col("_from")), part_of(F.col("length_cumsum") - 1)))
    t = t.where(F.col("End") > F.col("Start")).withColumn("part", p)
    lo, hi = F.greatest(begin(F.col("part")), F.col("_from")), F.least(begin(F.col("part") + 1), F.col("length_cumsum"))
    return t.select("Chromosome", (F.col("Start") + lo - F.col("_from")).alias("Start"), (F.col("Start") + hi - F.col("_from")).alias("End"), *annots(df), "part")


def cumulative(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds ``length_cumsum``, the total length up to and with each row in frame order."""
    here = running(df, ["Chromosome"], F.col("End") - F.col("Start"), "sum", "_before")
    totals = with_contig(df.groupBy("Chromosome").agg(F.sum(F.col("End") - F.col("Start")).alias("_n")), contigs)
    from pyspark.sql import Window

    w = Window.orderBy(F.col("contig_idx").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row per contig
    totals = totals.select("Chromosome", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_contigs"))
    t = here.join(totals, "Chromosome")
    return t.select(*df.columns, (F.col("_contigs") + F.coalesce("_before", F.lit(0)) + F.col("End") - F.col("Start")).alias("length_cumsum"))


def self_overlapping(df: DataFrame) -> DataFrame:
    """Rows that overlap one that stands before them (touching is allowed); empty if the frame has no overlap."""
    t = running(df, ["Chromosome"], F.col("End"), "max", "_top")
    return t.where(F.col("Start") < F.col("_top")).drop("_top")


def compact(df: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame on dense coordinates, decoder): each row becomes [k, k + 1) with k its rank on the contig; the decoder has
    Chromosome, k, Start, End."""
    ranked = running(df, ["Chromosome"], F.lit(1), "sum", "_k").withColumn("k", F.coalesce("_k", F.lit(0)).cast("long"))
    dense = ranked.select("Chromosome", F.col("k").alias("Start"), (F.col("k") + 1).alias("End"), *annots(df))
    return dense, ranked.select("Chromosome", "k", "Start", "End")


def uncompact(dense: DataFrame, decoder: DataFrame) -> DataFrame:
    """The inverse for runs [a, b) of dense coordinates: from the start of rank a to the end of rank b - 1."""
    rest = annots(dense)
    t = dense.withColumnsRenamed({"Start": "_a", "End": "_b"})
    first = decoder.select("Chromosome", F.col("k").alias("_a"), F.col("Start"))
    last = decoder.select("Chromosome", (F.col("k") + 1).alias("_b"), F.col("End"))
    return t.join(first, ["Chromosome", "_a"]).join(last, ["Chromosome", "_b"]).select(*COORDS, *rest)


def split_widths(total: Column, width: Column) -> Column:
    """Widths of the pieces of a length: whole multiples of ``width`` with the remainder spread over the leading pieces."""
    n = F.greatest(F.floor(total / width), F.lit(1)).cast("int")
    base, more = F.floor(total / n).cast("long"), (total % n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: base + F.when(i < more, 1).otherwise(0).cast("long"))
