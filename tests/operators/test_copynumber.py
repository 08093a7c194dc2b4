import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import copynumber as cn
from spanforge.functions import distributions as d
from spanforge.operators import copynumber


def test_segments_of_steps():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(200, 2.0), np.full(60, 3.0), np.full(240, 2.0)]) + rng.normal(0, 0.15, 500)
    at = copynumber.circular_segments(x)
    assert len(at) == 4 and abs(at[1] - 200) <= 2 and abs(at[2] - 260) <= 2
    assert copynumber.circular_segments(rng.normal(0, 1, 400)) == [0, 400]
    assert copynumber.circular_segments(np.array([])) == [0] and copynumber.circular_segments(np.ones(50)) == [0, 50]


def test_segment_frame(spark):
    rows = [("1", i * 10, i * 10 + 10, 1.0 if i < 30 else 9.0 + i % 2 * 0.1) for i in range(60)] + [("1", 600, 610, None), ("1", 610, 620, math.nan), ("2", 0, 10, 4.0)]
    out = copynumber.segment(spark.createDataFrame(rows, "Chromosome string, Start bigint, End bigint, x double"), "x")
    assert sorted((r.Chromosome, r.Start, r.End, r.N) for r in out.collect()) == [("1", 0, 300, 30), ("1", 300, 600, 30), ("2", 0, 10, 1)]
    wide = copynumber.segment(spark.createDataFrame(rows, "Chromosome string, Start bigint, End bigint, x double"), "x", width=7)
    assert sum(r.N for r in wide.collect()) == 61


def test_distributions():
    assert np.allclose(d.lgamma(np.array([0.5, 1, 10, 1e6])), [math.lgamma(x) for x in (0.5, 1, 10, 1e6)], rtol=1e-12)
    n, p = 30, 0.3
    exact = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    assert np.allclose(d.binom_cdf(np.arange(n + 1), n, p), exact, atol=1e-12)
    assert d.binom_cdf(np.array([50_000]), 100_000, 0.5)[0] == pytest.approx(0.50126, abs=1e-4)
    assert d.binom_test(5, 10) == pytest.approx(1.0) and d.binom_test(0, 10) == pytest.approx(2 / 1024) and math.isnan(d.binom_test(0, 0))
    grid = np.linspace(-60, 60, 200_001)
    assert d.t_pdf(grid, 5, 1.0, 2.0).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(0)
    assert d.ks_uniform(rng.random(500)) > 0.01 > d.ks_uniform(rng.random(500) ** 2) and math.isnan(d.ks_uniform(np.array([])))


def test_peaks_of_fractions(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in np.clip(rng.normal(0.33, 0.02, 800), 0, 0.5)] + [("a", None), ("a", math.nan), ("b", 0.2), (None, 0.1)]
    out = {r.s: r for r in copynumber.fraction_peaks(spark.createDataFrame(rows, "s string, baf double"), ["s"], "baf", 0.3).collect()}
    assert out["a"].ndata == 800 and abs(out["a"].center - 0.33) < 0.01 and 0.02 < out["a"].width < 0.1 and out["a"].left < out["a"].center < out["a"].right
    assert out["b"].ndata == 1 and set(out) == {"a", "b", None}


def test_solutions_and_nulls(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    k, c = 12.0, 0.6
    a, b = (k * (2 * (1 - c) + t * c) for t in (1, 3))
    x = one(cn.solve_kc(a, 1, 2, b, 3, 2))
    assert (x.k, x.c) == (pytest.approx(k), pytest.approx(c))
    x = one(cn.solve_kc(1.0, 1, 2, 1.0, 3, 2))
    assert (x.k, x.c) == (None, None)
    assert one(cn.clonal_cnt(F.lit(None).cast("double"), c, k, 2)) is None and one(cn.clonal_cnt(5.0, c, k, 0)) == 0
    assert one(cn.predicted_baf(0, 0, 1.0, 0, 0)) is None


def test_cell_fractions(spark):
    rows = [(0.3, 100, 30, 2.0, 2.0, 1.0), (0.05, 200, 10, 2.0, 2.0, 1.0), (0.62, 100, 62, 2.0, 4.0, 1.0), (None, 0, 0, 2.0, 2.0, 1.0), (0.3, 100, 30, 2.0, None, 1.0)]
    out = copynumber.cell_fractions(spark.createDataFrame(rows, "vaf double, total_depth bigint, alt_depth bigint, CNg double, CNt double, Bt double"), 0.7).collect()
    assert [(r.CNm, None if r.ccf is None else round(r.ccf, 3)) for r in out] == [(1.0, 1.0), (1.0, 0.143), (3.0, 1.0), (None, None), (None, None)]
