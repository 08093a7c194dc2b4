import json

from spanforge.operators import schema_drift

ROWS = {
    1: {"BIOTYPE": {"name": "mirna", "source": "S1"}, "Consequence": {"terms": ["a", "b"]}, "STRAND": 1, "extra": "e"},
    2: {"BIOTYPE": {"id": 7}, "Consequence": ["a", "b"], "STRAND": "minus"},
    3: {"BIOTYPE": {"name": "x"}, "Consequence": {"terms": ["a"], "name": "n"}, "STRAND": "-1"},
    4: {"BIOTYPE": None},
}


def test_unified_table_loses_no_value(spark):
    records = spark.createDataFrame([(1, k, json.dumps(v)) for k, v in ROWS.items()], "file_id bigint, row_no bigint, payload string")
    unified = spark.createDataFrame([(1, f, f) for f in ("BIOTYPE", "Consequence", "STRAND")], "file_id bigint, name string, field string")
    out = schema_drift.unified_table(records, unified, [("BIOTYPE", "string"), ("Consequence", "string"), ("STRAND", "number")])
    got = {r.row_no: r for r in out.collect()}
    assert [got[i].BIOTYPE for i in (1, 2, 3, 4)] == ["mirna", '{"id":7}', "x", None]
    assert [got[i].Consequence for i in (1, 2, 3)] == ["a&b", "a&b", "a"]
    assert [got[i].STRAND for i in (1, 2, 3)] == [1.0, None, -1.0]
    other = {i: {k: v if k in ("extra", "STRAND") else json.loads(v) for k, v in got[i].other.items()} for i in got}
    assert other == {1: {"BIOTYPE": ROWS[1]["BIOTYPE"], "extra": "e"}, 2: {"STRAND": "minus"}, 3: {"Consequence": ROWS[3]["Consequence"]}, 4: {}}


def _drift(spark, payloads, files, fields):
    records = spark.createDataFrame([(f, i, p, "x") for f, i, p in payloads], "file_id bigint, row_no bigint, payload string, name string")
    listed = spark.createDataFrame(files, "file_id bigint, feed string, produced_at timestamp, type string")
    dictionary = spark.createDataFrame([(f, "string") for f in fields], "field string, json_type string")
    return sorted(tuple(r) for r in schema_drift.drift(records, listed, dictionary)[1].collect())


def test_changes_between_files(spark):
    from datetime import datetime

    day = [datetime(2024, 1, d) for d in range(1, 7)]
    genes = [f"gene{i}x" for i in "abcdefgh"]
    rows = {
        1: [{"SYMBOL": g, "n": 1, "old": "o"} for g in genes],
        2: [{"symbol": g, "n": "1", "fresh": None} for g in genes],
        3: [{"symbol": g, "n": "1", "fresh": [1]} for g in genes],
    }
    payloads = [(f, i, json.dumps(r)) for f, rs in rows.items() for i, r in enumerate(rs)] + [(3, 99, None), (3, 98, "[1]"), (3, 97, "{broken"), (7, 0, "{}")]
    files = [(f, "a", day[f], None) for f in (1, 2, 3)] + [(2, "a", day[2], "copy"), (7, None, None, None)]
    assert _drift(spark, payloads, files, ["SYMBOL"]) == [(2, "SYMBOL", "renamed"), (2, "fresh", "added"), (2, "n", "retyped"), (2, "old", "removed")]


def test_no_records(spark):
    assert _drift(spark, [], [], ["SYMBOL"]) == []


def test_best_assignment_is_the_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 4, 2))
        s = np.where(rng.random((n, m)) < 0.4, 0, rng.random((n, m)))
        best = max(sum(s[i, j] for i, j in enumerate(p) if j < m) for p in itertools.permutations(range(m + n), n))
        got = schema_drift.best_assignment(s)
        assert abs(sum(s[i, j] for i, j in enumerate(got) if j >= 0) - best) < 1e-9 and len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
