from datetime import datetime, timedelta

import pytest

from spanforge.streaming import windows

T0 = datetime(2024, 1, 1)
ROWS = [(1, "a", T0, 1.0), (2, "a", T0 + timedelta(minutes=10), 2.0), (3, "a", T0 + timedelta(hours=5), 4.0), (4, None, T0, 8.0), (5, "b", None, 16.0), (1, "a", T0, 1.0)]
SCHEMA = "id bigint, k string, ts timestamp, value double"


@pytest.fixture
def stream(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def _run(spark, df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_tumbling_static(spark):
    t = windows.tumbling(spark.createDataFrame(ROWS, SCHEMA), "ts", ["k"], "value")
    assert sorted((r.k or "", r.n, r.total) for r in t.collect()) == [("", 1, 8.0), ("a", 1, 4.0), ("a", 3, 4.0)]
    assert windows.tumbling(spark.createDataFrame(ROWS, SCHEMA), "ts", ["k"], "value", "1 hour", "30 minutes").count() == 6


def test_tumbling_stream(spark, stream, tmp_path):
    got = _run(spark, windows.tumbling(stream, "ts", ["k"], "value"), tmp_path, "append")
    assert sorted((r[0] or "", r[3], r[4]) for r in got) == [("", 1, 8.0), ("a", 3, 4.0)]  # the last window is still open


def test_copies_and_sessions_stream(spark, stream, tmp_path):
    assert sorted(r[0] for r in _run(spark, windows.first_copies(stream, ["id"], "ts"), tmp_path, "append")) == [1, 2, 3, 4]
    s = windows.sessions(spark.createDataFrame(ROWS, SCHEMA), "ts", ["k"])
    assert sorted((r.k or "", r.n) for r in s.collect()) == [("", 1), ("a", 1), ("a", 3)]


def test_running_totals(spark, stream, tmp_path):
    got = _run(spark, windows.running_totals(stream, "k", "value", "ts"), tmp_path, "update")
    assert sorted((r[0] or "", r[1], r[2]) for r in got) == [("", 1, 8.0), ("a", 4, 8.0)]
