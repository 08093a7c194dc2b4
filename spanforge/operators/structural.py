"""Structural variants: classes, sizes, clustering distances and break ends.

Defined results: contigs are compared in one spelling; a strand that is neither + nor - gives no class (null); rows with a
null place have no size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.alleles import normalize_chrom


def sv_class(chrom1: Column, chrom2: Column, strand1: Column, strand2: Column) -> Column:
    """translocation, inversion, deletion or tandem-duplication."""
    a, b = normalize_chrom(chrom1, True), normalize_chrom(chrom2, True)
    known = strand1.isin("+", "-") & strand2.isin("+", "-")
    return F.when(a != b, "translocation").when(~known | (a != b).isNull(), F.lit(None)).when(strand1 != strand2, "inversion").when(strand1 == "+", "deletion").when(strand1 == "-", "tandem-duplication")


def size_bin(kind: Column, length: Column) -> Column:
    """Size class of a variant; translocations have class 0."""
    return (
        F.when(kind.isNull() | length.isNull(), F.lit(None)).when(kind == "translocation", "0").when(length <= 10_000, "1-10Kb").when(length <= 100_000, "10-100Kb")
        .when(length <= 1_000_000, "100Kb-1Mb").when(length <= 10_000_000, "1Mb-10Mb").otherwise(">10Mb")
    )


def classified(df: DataFrame, least: int = 1000) -> DataFrame:
    """Adds svclass, length and size_bin to rows with chrom1, start1, chrom2, start2, strand1, strand2; variants within a
    contig of less than ``least`` bases and those without a class are left out."""
    t = df.withColumn("svclass", sv_class(F.col("chrom1"), F.col("chrom2"), F.col("strand1"), F.col("strand2"))).withColumn("length", F.abs(F.col("start1") - F.col("start2")))
    t = t.withColumn("size_bin", size_bin(F.col("svclass"), F.col("length")))
    return t.where(F.col("size_bin").isNotNull() & ((F.col("svclass") == "translocation") | (F.col("length") >= least)))


def breakpoints(df: DataFrame, key: str) -> DataFrame:
    """Two rows per variant: key, sample, chrom, pos, partner (the other place if it is on the same contig)."""
    a, b = normalize_chrom(F.col("chrom1"), True), normalize_chrom(F.col("chrom2"), True)
    ends = F.array(
        F.struct(a.alias("chrom"), F.col("start1").alias("pos"), F.when(a == b, F.col("start2")).alias("partner"), F.lit(1).alias("side")),
        F.struct(b.alias("chrom"), F.col("start2").alias("pos"), F.when(a == b, F.col("start1")).alias("partner"), F.lit(2).alias("side")),
    )
    return df.select(key, "sample", F.explode(ends).alias("x")).select(key, "sample", "x.*").where(F.col("chrom").isNotNull() & F.col("pos").isNotNull())


def distances(points: DataFrame, least: int = 10) -> DataFrame:
    """Adds imd, the distance to the preceding break point of the sample and contig that is not the partner; that of the
    first is its place. Only contigs with at least ``least`` break points of a sample."""
    keys = ["sample", "chrom"]
    w = Window.partitionBy(*keys)
    t = points.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    order = w.orderBy("pos", "side")
    t = t.withColumn("_before", F.lag("pos").over(order))
    places = points.select(*keys, "pos").distinct()
    places = places.withColumn("_earlier", F.lag("pos").over(w.orderBy("pos"))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("pos").alias("_at"), "_earlier")
    on = F.col("sample").eqNullSafe(F.col("_sample")) & (F.col("chrom") == F.col("_chrom")) & (F.col("_before") == F.col("_at"))
    t = t.join(places, on, "left")
    prev = F.when(F.col("_before") == F.col("partner"), F.col("_earlier")).otherwise(F.col("_before"))
    return t.select(*points.columns, F.when(F.col("_before").isNull(), F.col("pos")).otherwise(F.col("pos") - prev).alias("imd"))


def breakend_type(chrom1: Column, chrom2: Column, is5_1: Column, is5_2: Column) -> Column:
    """TRA, DEL, DUP or INV by contigs and by whether the 5' side is joined."""
    return F.when(chrom1 != chrom2, "TRA").when(~is5_1 & is5_2, "DEL").when(is5_1 & ~is5_2, "DUP").when(is5_1 == is5_2, "INV")


def breakend_alt(base: Column, chrom: Column, pos: Column, is5: Column, mate_is5: Column, inserted: Column | None = None) -> Column:
    """The alternative that names the mate of a break end."""
    bracket = F.when(mate_is5, "[").otherwise("]")
    mate = F.concat(bracket, chrom, F.lit(":"), pos.cast("string"), bracket)
    ins = inserted if inserted is not None else F.lit("")
    return F.when(is5, F.concat(mate, ins, base)).otherwise(F.concat(base, ins, mate))


def cn48_class(total: Column, minor: Column, length: Column) -> Column:
    """One of the 48 classes of copy-number segments: copies, zygosity and size."""
    n = F.when(total <= 1, "1").when(total == 2, "2").when(total <= 4, "3-4").when(total <= 8, "5-8").otherwise("9+")
    state = F.when(total == 0, "homdel").when((minor == 0) | (total == minor), "LOH").otherwise("het")
    size = F.when(length <= 100_000, "0-100kb").when(length <= 1_000_000, "100kb-1Mb")
    big = F.when(length <= 10_000_000, "1Mb-10Mb").when(length <= 40_000_000, "10Mb-40Mb").otherwise(">40Mb")
    known = total.isNotNull() & minor.isNotNull() & length.isNotNull()
    return F.when(known, F.concat(F.when(total == 0, "0").otherwise(n), F.lit(":"), state, F.lit(":"), F.coalesce(size, F.when(total == 0, F.lit(">1Mb")).otherwise(big))))


def cn48_features() -> list[str]:
    """The 48 classes."""
    sizes = ["0-100kb", "100kb-1Mb", "1Mb-10Mb", "10Mb-40Mb", ">40Mb"]
    loh = [f"{n}:LOH:{s}" for n in ("1", "2", "3-4", "5-8", "9+") for s in sizes]
    het = [f"{n}:het:{s}" for n in ("2", "3-4", "5-8", "9+") for s in sizes]
    return [f"0:homdel:{s}" for s in ("0-100kb", "100kb-1Mb", ">1Mb")] + loh + het
