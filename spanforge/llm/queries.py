"""Queries of the llm operators (problems 1, 6, 7 and 8)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import bpe, packing, quantiles, reading
from spanforge.runtime import table


#: Percentiles that come out.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
DEPTH_STEP, COUNT_STEP = 0.01, 1.0
#: Error of p1_rank_bound, at which digests of some ten thousand values compress.
COARSE = 0.02


def _depths(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of depth; copies of a bin count once (with the greatest depth, should they differ)."""
    rows = table(spark, sf, "depth_rawdata").where(F.abs("depth") < float("inf"))  # nor null nor NaN
    once = rows.groupBy("run_id", "Chromosome", "Start", "sample", "run_day").agg(F.max("depth").alias("depth"))
    return once.select("sample", "run_day", quantiles.leaf(F.col("depth"), DEPTH_STEP).alias("leaf"))


def _depth_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of depth per sample and day."""
    return quantiles.digests(_depths(spark, sf), ["sample", "run_day"], "leaf")


def p1_depth_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of depth per sample and day."""
    return quantiles.percentiles(_depth_digests(spark, sf), ["sample", "run_day"], QUANTILES, DEPTH_STEP)


def p1_depth_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable state behind p1_depth_percentiles."""
    return _depth_digests(spark, sf)


def p1_depth_all_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of depth per sample, from the merged digests of its days."""
    return quantiles.percentiles(quantiles.merge(_depth_digests(spark, sf), ["sample"]), ["sample"], QUANTILES, DEPTH_STEP)


def p1_rank_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the percentiles of all depths, from digests per sample that compress and are merged, keep their bound."""
    leaves = _depths(spark, sf)
    parts = quantiles.digests(leaves, ["sample"], "leaf", COARSE).withColumn("_salt", F.pmod(F.xxhash64("sample"), F.lit(quantiles.SALTS)))
    whole = quantiles.merge(quantiles.merge(parts, ["_salt"], COARSE), [], COARSE)
    state = whole.first()  # one digest
    if state is None:
        return spark.createDataFrame([], "quantile string, n bigint, rank_error bigint, within boolean")
    counts = np.array(state["counts"])
    at = quantiles.query(np.array(state["nodes"]), counts, list(QUANTILES.values()))
    n, k = int(counts.sum()), quantiles.compression(COARSE)
    off = n // k * quantiles.HEIGHT
    ends = [F.struct(F.lit(name).alias("quantile"), F.lit(math.ceil(p * n - 1e-9)).alias("wanted"), F.sum((F.col("leaf") < int(x)).cast("long")).alias("lo"), F.sum((F.col("leaf") <= int(x)).cast("long")).alias("hi")) for (name, p), x in zip(QUANTILES.items(), at, strict=True)]
    found = leaves.agg(F.array(*ends).alias("x")).select(F.inline("x"))
    within = (F.col("wanted") >= F.col("lo") + 1 - off) & (F.col("wanted") <= F.col("hi") + off)
    return found.select("quantile", F.lit(n).cast("long").alias("n"), F.lit(off).cast("long").alias("rank_error"), within.alias("within"))


def _readcount_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the read counts per sample and allele class; copies of a row count once."""
    rows = table(spark, sf, "readstats").select("variant_id", "sample", F.explode("rppcounts").alias("allele_class", "reads"))
    once = rows.where(F.col("reads").isNotNull()).groupBy("variant_id", "sample", "allele_class").agg(F.max("reads").alias("reads"))
    leaves = once.withColumn("leaf", quantiles.leaf(F.col("reads"), COUNT_STEP))
    return quantiles.digests(leaves, ["sample", "allele_class"], "leaf")


def p1_readcount_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the read counts per sample and allele class."""
    return quantiles.percentiles(_readcount_digests(spark, sf), ["sample", "allele_class"], QUANTILES, COUNT_STEP)


def p1_readcount_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable state behind p1_readcount_percentiles."""
    return _readcount_digests(spark, sf)


def p1_readcount_all_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the read counts per allele class, from the merged digests of the samples."""
    return quantiles.percentiles(quantiles.merge(_readcount_digests(spark, sf), ["allele_class"]), ["allele_class"], QUANTILES, COUNT_STEP)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again (a null text comes back empty)."""
    return bpe.decode_corpus(p6_ids(spark, sf))


def p7_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pieces of documents in containers of each capacity."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")), table(spark, sf, "pack_capacity"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity: documents assigned, containers filled beyond it, pieces that overlap the one before them, and documents
    whose pieces don't follow each other."""
    t = p7_assignment(spark, sf)
    # documents without tokens, of which any number may lie in a container, are spread
    spread = F.when(F.col("n_tokens") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    inside = Window.partitionBy("capacity_id", "container_id", spread).orderBy("offset")
    along = Window.partitionBy("capacity_id", "doc_id").orderBy("first_token")
    before, at = F.lag(F.col("offset") + F.col("n_tokens")).over(inside), F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens")).over(along), F.lit(0))
    real = F.col("n_tokens") > 0
    t = t.join(table(spark, sf, "pack_capacity").select("capacity_id", "capacity_tokens"), "capacity_id")
    t = t.select("capacity_id", "doc_id", (F.col("offset") + F.col("n_tokens") > F.col("capacity_tokens")).alias("over"), (real & (F.col("offset") < before)).alias("overlap"), (F.col("first_token") != at).alias("broken"))
    return t.groupBy("capacity_id").agg(F.count_distinct("doc_id").alias("documents"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("over", "overlap", "broken")])


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Reading level and band of the own prose of every post that has one."""
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose own prose is of band 3."""
    return p8_levels(spark, sf).where(F.col("band") == 3).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_depth_percentiles, p1_depth_digests, p1_depth_all_days, p1_rank_bound, p1_readcount_percentiles, p1_readcount_digests, p1_readcount_all_samples, p6_ids, p6_round_trip, p7_assignment, p7_containers, p8_levels, p8_found)}


def oracle_sql() -> dict[str, str]:
    """Exact percentiles by nearest rank: at this scale every group of the first two is below the size from which digests
    compress; p1_rank_bound compresses."""

    def exact(source: str, keys: str, value: str, step: str) -> str:
        cols = ", ".join(f"round(min(CASE WHEN r >= ceil({q} * n - 1e-9) THEN v END), 9) AS {name}" for name, q in QUANTILES.items())
        return f"""
WITH once AS ({source}),
r AS (SELECT *, {step} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM once)
SELECT {keys}, max(n) AS n, {cols}, CAST(floor(max(n) / {quantiles.compression()}) * {quantiles.HEIGHT} AS BIGINT) AS rank_error FROM r GROUP BY {keys}"""

    def coded(x: str, step: float) -> str:
        """The value that stands for x: steps of equal width, then of equal relative width."""
        top, e = (1 << quantiles.LINEAR_BITS) - 0.5, f"(floor(log2({x} / {step})) - {quantiles.LINEAR_BITS - 1})"
        return f"CASE WHEN {x} < {top * step} THEN round_even({x} / {step}, 0) * {step} ELSE (floor({x} / pow(2, {e}) / {step}) + 0.5) * {step} * pow(2, {e}) END"

    depth = """SELECT run_id, Chromosome, "Start", "sample", run_day, max(depth) AS depth FROM depth_rawdata
               WHERE depth IS NOT NULL AND NOT isnan(depth) GROUP BY ALL"""
    reads = """SELECT variant_id, "sample", allele_class, max(reads) AS reads
               FROM (SELECT variant_id, "sample", unnest(map_keys(rppcounts)) AS allele_class, unnest(map_values(rppcounts)) AS reads FROM readstats)
               WHERE reads IS NOT NULL GROUP BY ALL"""
    names = ", ".join(f"('{x}')" for x in QUANTILES)
    return {
        "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_containers": "SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS broken FROM pack_capacity WHERE capacity_tokens >= 1",
        "p1_rank_bound": f"""
WITH once AS ({depth}), c AS (SELECT count(*) AS n FROM once)
SELECT q AS quantile, n, CAST(floor(n / {quantiles.compression(COARSE)}) * {quantiles.HEIGHT} AS BIGINT) AS rank_error, true AS within FROM c, (VALUES {names}) AS v(q)""",
        "p1_depth_all_days": exact(depth, '"sample"', "depth", coded("depth", DEPTH_STEP)),
        "p1_readcount_all_samples": exact(reads, "allele_class", "reads", coded("reads", COUNT_STEP)),
        "p1_depth_percentiles": exact(depth, '"sample", run_day', "depth", coded("depth", DEPTH_STEP)),
        "p1_readcount_percentiles": exact(reads, '"sample", allele_class', "reads", coded("reads", COUNT_STEP)),
    }
