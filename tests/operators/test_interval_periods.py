from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators.interval_periods import disjoint_lists, merge_lists, periods_and_gaps


def _want(rows):
    out = set()
    for k in {r[0] for r in rows}:
        iv = sorted((s, e) for kk, s, e in rows if kk == k and None not in (kk, s, e) and e > s)
        runs = []
        for s, e in iv:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out |= {(k, "period", s, e) for s, e in runs} | {(k, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


num = st.one_of(st.none(), st.integers(-60, 60))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), num, num), min_size=1, max_size=40))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").repartition(3)
    for tile in (None, 7):
        got = [tuple(r) for r in periods_and_gaps(disjoint_lists(df, ["k"], "s", "e", tile), ["k"]).collect()]
        assert set(got) == _want(rows) and len(got) == len(set(got))


def test_microseconds_and_a_hot_entity(spark):
    t0 = 1_700_000_000_000_000
    rows = [("hot", t0 + i * 10**9, t0 + i * 10**9 + 5 * 10**8) for i in range(3000)] + [("b", t0, t0 + 1)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").repartition(9)
    lists = disjoint_lists(df, ["k"], "s", "e")
    out = {(r.k, r.kind): r.n for r in periods_and_gaps(lists, ["k"]).groupBy("k", "kind").count().withColumnRenamed("count", "n").collect()}
    assert out == {("hot", "period"): 3000, ("hot", "gap"): 2999, ("b", "period"): 1}


def test_loads_combine(spark):
    df = spark.createDataFrame([("a", 0, 5, "x"), ("a", 3, 9, "y"), ("a", 20, 30, "z")], "k string, s bigint, e bigint, starts string")
    a, b = (disjoint_lists(df.where(c), ["k"], "s", "e", 8) for c in ("s = 3", "s <> 3"))
    assert sorted((r.kind, r.start0, r.end0) for r in periods_and_gaps(merge_lists(a, b, ["k"]), ["k"]).collect()) == [("gap", 9, 20), ("period", 0, 9), ("period", 20, 30)]
    assert periods_and_gaps(disjoint_lists(df.where("false"), ["k"], "s", "e"), ["k"]).collect() == []
