"""Windows over event time. Every function takes a static or a streaming table; on a stream state is bounded by the watermark.

Defined results: rows without a time are left out; rows later than the watermark are dropped by the stream, as it must be;
null keys form a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    t = df.where(F.col(time).isNotNull())
    return t.withWatermark(time, late) if df.isStreaming else t


def tumbling(df: DataFrame, time: str, keys: Sequence[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """keys, start, end, n, total per window (overlapping windows, if ``slide`` is shorter than ``size``)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    t = _timed(df, time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return t.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """keys, start, end, n of runs of events with gaps below ``gap``; the end is the last event and the gap."""
    t = _timed(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return t.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_copies(df: DataFrame, keys: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """One row per key: on a stream copies are known within the watermark."""
    t = _timed(df, time, late)
    return t.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else t.dropDuplicates(list(keys))


def running_totals(df: DataFrame, key: str, value: str, time: str, late: str = "1 hour") -> DataFrame:
    """key, n, total so far, by a state per key that is dropped after ``late`` without events. Streams only."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
            top = pdf[time].max()
            last = top if last is None else max(last, top)
        state.update((n, total))
        if last is not None:
            state.setTimeoutTimestamp(int(last.timestamp() * 1000) + int(pd.Timedelta(late).total_seconds() * 1000))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    t = _timed(df, time, late)
    return t.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n bigint, total double", "n bigint, total double", "update", "EventTimeTimeout")
