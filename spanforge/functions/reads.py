"""Column functions on sequencing reads: flags, CIGAR strings, orientation; and counts per place of tall pileups.

Defined results: null in, null out; an operation of length 0 is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_good(flag: Column) -> Column:
    """Paired, both mapped, no duplicate."""
    return has(flag, PAIRED) & ~has(flag, UNMAPPED) & ~has(flag, MATE_UNMAPPED) & ~has(flag, DUPLICATE)


def for_pileup(flag: Column) -> Column:
    return is_good(flag) & ~has(flag, SUPPLEMENTARY) & ~has(flag, SECONDARY)


def orientation(flag: Column, template_length: Column) -> Column:
    """f1r2, f2r1 and so on, the left read first; null without a mapped mate on the contig."""
    me = F.concat(F.when(has(flag, REVERSE), "r").otherwise("f"), F.when(has(flag, FIRST), "1").otherwise("2"))
    mate = F.concat(F.when(has(flag, MATE_REVERSE), "r").otherwise("f"), F.when(has(flag, FIRST), "2").otherwise("1"))
    return F.when(has(flag, MATE_UNMAPPED) | (template_length == 0), F.lit(None)).when(template_length > 0, F.concat(me, mate)).otherwise(F.concat(mate, me))


def cigar(text: Column) -> Column:
    """Array of struct(op, len)."""
    n, op = F.regexp_extract_all(text, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(text, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1))
    return F.filter(F.zip_with(n, op, lambda a, b: F.struct(b.alias("op"), a.cast("int").alias("len"))), lambda x: x["len"] > 0)


def _length(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda s, x: s + x["len"])


def reference_length(ops: Column) -> Column:
    return _length(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return _length(ops, "MIS=X")


def soft_clips(ops: Column) -> Column:
    """struct(left, right): clipped bases at both ends."""
    at = lambda x: F.when(x["op"] == "S", x["len"]).otherwise(0)
    return F.struct(at(F.get(ops, F.lit(0))).alias("left"), F.when(F.size(ops) > 1, at(F.element_at(ops, -1))).otherwise(0).alias("right"))


def aligned_blocks(pos0: Column, ops: Column) -> Column:
    """Array of struct(start, end, query): the parts of a read that lie on reference bases."""
    zero = F.struct(pos0.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<start:bigint,end:bigint,query:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n, op = x["len"].cast("long"), x["op"]
        here = F.when(op.isin("M", "=", "X"), F.array(F.struct(s["r"].alias("start"), (s["r"] + n).alias("end"), s["q"].alias("query")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,query:bigint>>"))
        return F.struct((s["r"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("r"), (s["q"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("q"), F.concat(s["out"], here).alias("out"))

    return F.aggregate(ops, zero, step, lambda s: s["out"])


def allele_portions(df: DataFrame, place: list[str], base: str, quality: str | None = None, reference: str | None = None, cutoff: int = 15) -> DataFrame:
    """place, base, n, portion, depth of a tall pileup (a row per read and place); bases of low quality count as the
    reference's; null bases are no reads."""
    b = F.col(base) if quality is None else F.when(F.col(quality) < cutoff, F.col(reference)).otherwise(F.col(base))
    t = df.withColumn("_b", b).where(F.col("_b").isNotNull()).groupBy(*place, F.col("_b").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.sum("n").over(Window.partitionBy(*place))
    return t.withColumn("depth", depth).withColumn("portion", F.col("n") / F.col("depth"))


def consensus(portions: DataFrame, place: list[str], threshold: float = 0.5, ambiguous: str = "X") -> DataFrame:
    """place, base: the base of more than ``threshold`` of the reads, else ``ambiguous``."""
    best = portions.groupBy(*place).agg(F.max_by(F.struct("base", "portion"), F.struct("portion", "base")).alias("x"))
    return best.select(*place, F.when(F.col("x.portion") > threshold, F.col("x.base")).otherwise(ambiguous).alias("base"))


def merge_classes(a: Column, b: Column) -> Column:
    """Allele class of a pair from those of its reads: equal ones or the only one; null where they differ."""
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a)
