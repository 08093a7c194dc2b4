import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanforge.functions import distributions as d
from spanforge.operators import readsupport, signatures


def test_keys():
    assert len(set(signatures.sbs96_keys())) == 96 and len(set(signatures.id83_keys())) == 83
    assert [signatures.catalogue_type(k) for k in (signatures.sbs96_keys()[::-1], signatures.SUBSTITUTIONS, signatures.id83_keys(), ["x"])] == ["sbs96", "sbs6", "id83", None]


def _matrix(rng, n=6):
    m = rng.dirichlet(np.full(96, 0.1), n).T
    return pd.DataFrame(m, index=signatures.sbs96_keys(), columns=[f"SBS{i}" for i in (2, 13, 4, 5, 6, 8)][:n])


def test_nnls_against_all_supports():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.normal(size=(8, 4)), rng.normal(size=8)
        x = signatures.nnls(a, b)
        best = min(
            (np.linalg.norm(a[:, s] @ z - b) for r in range(5) for s in map(list, itertools.combinations(range(4), r)) if (z := np.linalg.lstsq(a[:, s], b, rcond=None)[0]).min(initial=0) >= 0),
        )
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-8


def test_fit_and_stepwise(spark):
    rng = np.random.default_rng(2)
    m = _matrix(rng)
    g = np.rint(m["SBS4"] * 3000 + m["SBS2"] * 1000 + m["SBS13"] * 500).astype(int)
    e, dist = signatures.fit(m.to_numpy(), g.to_numpy())
    assert dist < 0.05 and e.sum() == g.sum() and abs(e[2] - 3000) < 150
    found, _ = signatures.assign(m.to_numpy(), g.to_numpy(), list(m.columns))
    assert set(found) == {"SBS2", "SBS4", "SBS13"}
    rows = [("a", c, int(n)) for c, n in g.items()] + [("empty", "A[C>A]A", 0), ("odd", "no class", 5)]
    out = signatures.fit_catalogues(spark.createDataFrame(rows, "sample string, class string, n long"), m)
    total = {r["sample"]: r.n for r in out.groupBy("sample").agg(F.sum("n").alias("n")).collect()}
    assert total == {"a": int(g.sum()), "empty": 0, "odd": 0}
    assert signatures.with_connected(["SBS2"], list(m.columns)) == ["SBS2", "SBS13"]


def test_bootstrap_and_factors(spark):
    rng = np.random.default_rng(3)
    cat = spark.createDataFrame([("s", k, i) for i, k in enumerate(signatures.SUBSTITUTIONS)] + [("t", "C>A", 0)], "sample string, class string, n long")
    a, b = (sorted(map(tuple, signatures.bootstrap_catalogues(cat, 1).collect())) for _ in range(2))
    assert a == b and sum(r[2] for r in a if r[0] == "s") == 15
    m = _matrix(rng, 2).to_numpy()
    h = rng.integers(50, 3000, (2, 30))
    w, k = signatures.nmf(rng.poisson(m @ h).astype(float), 2, seed=1)
    cos = (w.T @ m) / np.outer(np.linalg.norm(w, axis=0), np.linalg.norm(m, axis=0))
    assert cos.max(0).min() > 0.95 and np.allclose(w.sum(0), 1) and k.shape == (2, 30)


def test_pieces_peaks_and_simulation():
    y = np.r_[np.zeros(20), np.ones(15) * 4, np.ones(25)] + np.random.default_rng(0).normal(0, 0.1, 60)
    assert d.piecewise_constant(y, 3, 1.0) == [0, 20, 35, 60] and d.piecewise_constant(y[:4], 3, 1.0) == [0, 4] and d.piecewise_constant(y[:0], 3, 1.0) == [0]
    found = d.histogram_peaks(np.r_[np.full(50, 0.2), np.full(20, 0.8), np.nan], 10)
    assert len(found) == 2 and abs(found[0][0] - 0.23) < 0.05
    assert d.without_contained([(5, 1.0, 0.0, 10.0), (6, 0.5, 2.0, 8.0), (20, 1.0, 18.0, 22.0)]) == [(5, 1.0, 0.0, 10.0), (20, 1.0, 18.0, 22.0)]
    rng = np.random.default_rng(5)
    x = d.generalized_poisson(rng, 30, 0.2, 40_000)
    assert abs(x.mean() - 30) < 0.3 and abs(x.var() - 30 / 0.64) < 2.5
    f = d.simulated_fractions(rng, 40, np.array([0.7, 0.3]), 20_000)
    assert abs(np.nanmean(f[:, 0]) - 0.7) < 0.01 and np.allclose(np.nansum(f, 1)[~np.isnan(f[:, 0])], 1)


def test_read_support(spark):
    reads = spark.createDataFrame([(1, 0, 60.0, 0.1, "f1r2"), (1, 0, None, 0.9, "f2r1"), (1, 1, 20.0, None, "f1r2"), (1, None, 9.0, 0.5, "f1r2")], "v int, allele int, mq double, place double, o string")
    out = {r.allele: r for r in readsupport.summarize(reads, ["v"], "allele", ["mq"], orient="o").collect()}
    assert (out[0].n, out[0].mean_mq, out[0].f1r2, out[0].f2r1, out[1].n) == (2, 60.0, 1, 1, 1) and set(out) == {0, 1}
    p = {r.v: r.p_value for r in readsupport.uniform_pvalues(reads, ["v"], "place").collect()}
    assert 0 < p[1] <= 1 and readsupport.uniform_pvalues(reads.where("false"), ["v"], "place").collect() == []
    m = spark.createDataFrame([(1, r, "x") for r in range(9)] + [(1, 3, "y")], "v int, r int, m string")
    spans = spark.createDataFrame([(1, "x", 9), (1, "y", 9)], "v int, m string, n_span int")
    got = {r.m: r.recurrent for r in readsupport.recurrent_mismatches(m, ["v"], "r", "m", spans).collect()}
    assert got == {"x": True, "y": False}
