import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import quantiles as q

PS = {"p01": 0.01, "p50": 0.5, "p99": 0.99}


def test_compressed_digests_keep_the_rank_bound(spark):
    rng, eps, n = np.random.default_rng(1), 0.2, 40_000
    values = np.rint(rng.lognormal(3, 2, n) * 100) / 100
    rows = [(int(i % 7), float(v)) for i, v in enumerate(values)]  # seven loads
    df = spark.createDataFrame(rows, "load int, v double").withColumn("leaf", q.leaf(F.col("v"), 0.01))
    whole = q.merge(q.digests(df, ["load"], "leaf", eps), [], eps)
    row = q.percentiles(whole, [], PS, 0.01, eps).first()
    assert row.n == n and 0 < row.rank_error <= eps * n
    assert whole.select(F.size("nodes")).first()[0] <= 3 * q.compression(eps)
    ordered = np.sort(values)
    for name, p in PS.items():
        lo, hi = np.searchsorted(ordered, row[name] * (1 - 1e-6) - 0.006), np.searchsorted(ordered, row[name] * (1 + 1e-6) + 0.006)
        assert lo - row.rank_error <= math.ceil(p * n) <= hi + row.rank_error


@pytest.mark.parametrize("v", [0.0, -0.004, 0.005, 12.34, -1e7, 1e300, -1.7e308, 5e-324])
def test_every_finite_double_has_a_code(spark, v):
    leaf = spark.createDataFrame([(v,)], "v double").select(q.leaf(F.col("v"), 0.01)).first()[0]
    assert 0 <= leaf < 1 << q.HEIGHT
    back = q.value_of(np.array([leaf]), 0.01)[0]
    assert back == pytest.approx(v, rel=2.0**-19, abs=0.00501)


def test_codes_are_monotone(spark):
    values = sorted({s * x for x in (0, 0.01, 5.0, 10485.75, 10485.76, 10485.77, 20971.52, 1e6, 2.0**40, 1e200, 1e308) for s in (1, -1)})
    codes = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(q.leaf(F.col("v"), 0.01)).collect()]
    assert codes == sorted(codes)


def test_what_is_no_value(spark):
    rows = [("a", None), ("a", math.nan), ("a", math.inf), ("a", -math.inf), (None, 2.0), ("b", 1.0), ("b", 1.0), ("b", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("leaf", q.leaf(F.col("v"), 1.0)).withColumn("nodes", F.lit("clash"))
    got = {r.g: (r.n, r.p50, r.rank_error) for r in q.percentiles(q.digests(df, ["g"], "leaf"), ["g"], {"p50": 0.5}, 1.0).collect()}
    assert got == {None: (1, 2.0, 0), "b": (3, 1.0, 0)}
    assert q.digests(df.where("false"), ["g"], "leaf").collect() == []


def test_a_hot_group_in_many_partitions(spark):
    df = spark.range(6000).repartition(40).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("leaf"))
    got = {r.g: r.n for r in q.percentiles(q.digests(df, ["g"], "leaf", 0.05), ["g"], {"p50": 0.5}, 1.0, 0.05).collect()}
    assert got["hot"] == 4000 and len(got) == 2001 and sum(got.values()) == 6000
