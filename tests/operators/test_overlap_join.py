import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.operators import algebra, islands, overlap_join
from spanforge.operators.overlap_join import overlap_pairs

SCHEMA = "Chromosome string, Start bigint, End bigint"
CONTIGS = [("1", 10_000_000, 0), ("2", 500, 1)]


def test_edges(spark):
    a = spark.createDataFrame([("1", 0, 10), ("1", 10, 3000), ("2", 0, 5), ("1", 9, 9), (None, 0, 5), ("1", None, 5)], SCHEMA)
    b = spark.createDataFrame([("1", 10, 20, 1.0), ("1", 900, 2500, 3.0), ("1", 2999, 9999, math.nan), ("1", 20, 21, None), ("3", 0, 5, 1.0), ("1", 50, 40, 9.0)], SCHEMA + ", v double")
    got = {(r.Chromosome, r.Start): (r.N, r.v_mean, r.v_std) for r in overlap_join.overlap_join(a, b, "v").collect()}
    none = (0, None, None)
    assert got == {("1", 0): none, ("1", 10): (4, 2.0, 1.0), ("2", 0): none, ("1", 9): none, (None, 0): none, ("1", None): none}
    assert [r.N for r in overlap_join.overlap_join(a, b, "v", ["skew", "median", "first", "last"], "inner").collect()] == [4]
    empty = overlap_join.overlap_join(a, b.where("false"), "v")
    assert empty.count() == 6 and overlap_join.overlap_join(a.where("false"), b, "v").count() == 0


def test_names_that_clash(spark):
    a = spark.createDataFrame([("1", 0, 10, "x", 1)], SCHEMA + ", v string, N int")
    b = spark.createDataFrame([("1", 0, 10, 2.0)], SCHEMA + ", v double")
    with pytest.raises(ValueError):
        overlap_join.overlap_join(a, b, "v")
    assert overlap_join.overlap_join(a, b, "v", n_name="n").first().v_mean == 2.0


def test_nearest_fills_what_overlaps_nothing(spark):
    a = spark.createDataFrame([("1", 100, 110), ("1", 0, 5), ("2", 0, 5)], SCHEMA)
    b = spark.createDataFrame([("1", 90, 98, 1.0), ("1", 112, 120, 2.0), ("1", 7, 9, 3.0)], SCHEMA + ", v double")
    got = {(r.Chromosome, r.Start): (r.N, r.v_mean) for r in overlap_join.overlap_join(a, b, "v", ["mean"], find_nearest=True).collect()}
    assert got == {("1", 100): (0, 1.0), ("1", 0): (0, 3.0), ("2", 0): (0, None)}


def test_winsorize(spark):
    a = spark.createDataFrame([("1", 0, 1000)], SCHEMA)
    b = spark.createDataFrame([("1", i, i + 1, float(x)) for i, x in enumerate([100, 1, 2, 3, -50, 4, 5, 6, 7, 8])] + [("1", 20, 21, None)], SCHEMA + ", v double")
    r = overlap_join.overlap_join(a, b, "v", ["min", "max"], winsorize=(0.1, 0.2)).first()
    assert (r.N, r.v_min, r.v_max) == (11, 1.0, 7.0)


interval = st.tuples(st.sampled_from("12"), st.integers(0, 400), st.sampled_from([1, 2, 7, 60, 400, 5000, 2_000_000])).map(lambda x: (x[0], x[1], x[1] + x[2]))
rows = st.lists(interval, min_size=1, max_size=25)


def _cover(iv, chrom):
    return {p for c, s, e in iv if c == chrom for p in range(s, min(e, 6000))}


@settings(max_examples=8, deadline=None)
@given(rows, rows)
def test_pairs_of_all_lengths(spark, a, b):
    a, b = sorted(set(a)), sorted(set(b))
    got = sorted(tuple(r) for r in overlap_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect())
    assert got == sorted((c, s, e, s2, e2) for c, s, e in a for c2, s2, e2 in b if c == c2 and s < e2 and s2 < e)


@settings(max_examples=5, deadline=None)
@given(rows, rows)
def test_algebra_against_sets_of_positions(spark, a, b):
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for f, want in ((algebra.subtract, set.__sub__), (algebra.set_intersect, set.__and__), (algebra.set_union, set.__or__)):
        got = [tuple(r)[:3] for r in f(x, y).collect()]
        for chrom in "12":
            assert _cover(got, chrom) == want(_cover(a, chrom), _cover(b, chrom)), f.__name__
    clusters = {tuple(r)[:3]: r.Cluster for r in algebra.cluster(x).collect()}
    assert len({(k[0], v) for k, v in clusters.items()}) == algebra.merge(x).count()


def test_subtract_keeps_copies_and_nulls_in_annotations(spark):
    x = spark.createDataFrame([("1", 0, 10, None), ("1", 0, 10, None), ("1", 20, 30, "k")], SCHEMA + ", note string")
    got = sorted((r.Start, r.End, r.note or "") for r in algebra.subtract(x, spark.createDataFrame([("1", 3, 5)], SCHEMA)).collect())
    assert got == [(0, 3, ""), (0, 3, ""), (5, 10, ""), (5, 10, ""), (20, 30, "k")]


def test_segments_of_little_data(spark):
    c = spark.createDataFrame(CONTIGS, "Chromosome string, length bigint, idx int").withColumn("cum_start", F.lit(0))
    seg = spark.createDataFrame([("2", 10, 20, 1), ("2", 20, 40, 50), ("2", 40, 51, 2), ("2", 51, 80, 40), ("2", 80, 90, None)], SCHEMA + ", n int")
    got = sorted((r.Start, r.End) for r in islands.incorporate_low(seg, c, "n").collect())
    assert got == [(0, 45), (45, 500)]
    assert islands.incorporate_low(seg.where("false"), c, "n").collect() == []
