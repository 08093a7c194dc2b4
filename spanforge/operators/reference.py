"""Reference sequences as a table (Chromosome, chunk, seq): every chunk has the same width, the last of a contig may be
shorter. Windows are fetched by joining on (Chromosome, chunk), so no task holds a contig.

Defined results: a window beyond the sequence is cut; a window on an unknown contig is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetch(df: DataFrame, ref: DataFrame, width: int, start: Column, end: Column, keys: list[str], name: str = "seq") -> DataFrame:
    """``df`` with the sequence of [start, end) on its Chromosome; ``keys`` identify a row."""
    t = df.withColumns({"_s": F.greatest(start, F.lit(0)), "_e": end})
    need = t.select("Chromosome", *keys, "_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width))).alias("chunk"))
    got = need.join(ref.select("Chromosome", "chunk", "seq"), ["Chromosome", "chunk"])
    lo, hi = F.greatest(F.col("_s") - F.col("chunk") * width, F.lit(0)), F.least(F.col("_e") - F.col("chunk") * width, F.lit(width))
    part = F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))
    seq = got.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))).alias("_x")).select(*keys, F.array_join(F.transform("_x", lambda x: x["p"]), "").alias(name))
    return df.join(seq, keys, "left")


def gc_fraction(seq: Column) -> Column:
    """Part of G and C; null for an empty sequence."""
    return F.try_divide(F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", "")), F.length(seq))


def gc_by_bin(ref: DataFrame, width: int, bins: int) -> DataFrame:
    """Chromosome, Start, End, GC of bins of ``bins`` bases, of which a chunk holds a whole number."""
    n = F.ceil(F.length("seq") / bins)
    t = ref.select("Chromosome", "chunk", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    part = F.substr("seq", (F.col("i") * bins + 1).cast("int"), F.lit(bins))
    start = F.col("chunk") * width + F.col("i") * bins
    return t.select("Chromosome", start.alias("Start"), (start + F.length(part)).alias("End"), gc_fraction(part).alias("GC"))


def n_regions(ref: DataFrame, width: int) -> DataFrame:
    """Chromosome, Start, End of the runs of N, also over the borders of chunks."""
    from spanforge.operators.algebra import merge

    runs = F.regexp_extract_all("seq", F.lit("([Nn]+|[^Nn]+)"), F.lit(1))
    t = ref.select("Chromosome", "chunk", runs.alias("r"))
    ends = F.aggregate("r", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    t = t.select("Chromosome", "chunk", "r", ends.alias("e")).select("Chromosome", "chunk", "e", F.posexplode("r").alias("i", "x")).where(F.col("x").rlike("^[Nn]"))
    at = F.col("chunk") * width
    return merge(t.select("Chromosome", (at + F.get("e", F.col("i"))).cast("long").alias("Start"), (at + F.get("e", F.col("i") + 1)).cast("long").alias("End")))
