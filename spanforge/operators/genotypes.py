"""Genotypes of a variant over the samples of an individual.

Defined results: null counts are no reads; of alleles with equal votes or reads the lower class comes first; a variant
without blood or clonal sample has no inherited alleles (null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import readstats

#: Least fraction of an acquired allele by type of sample.
SOMATIC = {"blood": 0.05, "tumor": 0.05, "clonal": 0.2}


def genotypes(df: DataFrame, key: str, counts: str, kind: str, copies: int = 2) -> DataFrame:
    """key, germline, somatic: ``germline`` are the alleles with most votes, every blood or clonal sample voting for its
    ``copies`` most frequent ones; ``somatic`` the others that reach the least fraction of a type in some sample."""
    c = F.col(counts)
    votes = df.where(F.col(kind).isin("blood", "clonal")).select(key, F.explode(readstats.top_alleles(c, copies)).alias("allele")).groupBy(key, "allele").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "allele")))
    germline = votes.groupBy(key).agg(F.array_sort(F.transform(F.slice(order, 1, copies), lambda x: x["allele"])).alias("germline"))
    least = F.create_map(*[F.lit(x) for kv in SOMATIC.items() for x in kv])[F.col(kind)]
    n = readstats.total(c)
    seen = F.filter(F.map_entries(c), lambda e: (e["key"] >= 0) & (F.try_divide(e["value"], n) >= least))
    reached = df.select(key, F.explode(F.transform(seen, lambda e: e["key"])).alias("allele")).groupBy(key).agg(F.array_sort(F.collect_set("allele")).alias("seen"))
    t = df.select(key).distinct().join(germline, key, "left").join(reached, key, "left")
    empty = F.array().cast(f"array<{df.schema[counts].dataType.keyType.simpleString()}>")
    return t.select(key, "germline", F.array_except(F.coalesce("seen", empty), F.coalesce("germline", empty)).alias("somatic"))
