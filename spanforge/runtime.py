"""Session-level helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast explicitly only when it was counted and has at most this many rows and characters.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32 << 20
#: Parts into which hot keys of a lookup are split where the looked-up side is too large to be broadcast.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset (tests) make a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "spanforge-checkpoints")
    sc.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there: later uses don't recompute it,
    and the loss of an executor loses nothing. Spark removes the files when the frame is no longer referenced if the
    session has ``spark.cleaner.referenceTracking.cleanCheckpoints`` (see README)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether ``df`` (already materialized) has at most so many rows and characters (written as JSON)."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (size or 0) <= chars


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` (already materialized) with a broadcast hint if it is small, else ``df`` itself, which leaves a shuffle
    join with AQE's skew handling."""
    return F.broadcast(df) if is_small(df, rows, chars) else df


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str]) -> DataFrame:
    """Inner join with a materialized table of few rows per key: broadcast if it is small; else a shuffle join in which
    every key is split into SALTS parts by the hash of ``salt_by``, so that a hot key does not stay in one task."""
    if is_small(right):
        return left.join(F.broadcast(right), list(keys))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def bounded_slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``size`` bytes (or one row)."""
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from bounded_slices(part, size)
