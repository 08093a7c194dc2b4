"""Filling containers of fixed capacity with texts, as tightly as possible.

Length-histogram planning: the plan needs only how many items there are of each length, a table bounded by the
capacity. Best fit in descending length is run over these counts: containers with the same free space form one class,
and one step places as many equal items as a class takes. The plan is a list of segments (items of rank r0 to r1 of a
length go to containers c, c+1, ..). Documents then take their slots by joining on their rank within the length; hot
lengths are ranked in buckets whose offsets are added, so no task ranks a third of all rows.

Defined results: a document longer than the capacity is cut into full pieces and a remainder; a document without
tokens (null or empty text) takes no space and is put into container 0; repeated rows are items of their own; an empty
table gives no rows; a capacity that is null or below 1 is left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanforge.llm.bpe import TOKENIZER_DIR, encoded, encoder, load_merges
from spanforge.runtime import materialize, sized_broadcast

#: Rows of one length that a task ranks.
RANK_BUCKET = 250_000
REST, FULL, NONE = 0, 1, 2


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """key, n_tokens of every row."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer, directory))
    name = f"{directory or TOKENIZER_DIR}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, n in encoded(batches, encoder(name, shared.value)):
            yield pa.RecordBatch.from_arrays([keys, pa.array(n)], names=[key, "n_tokens"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, n_tokens bigint")


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(segments (length, r0, r1, copies, container, offset), number of containers).

    The item of rank r of a length lies in container + (r - r0) // copies at offset + (r - r0) % copies * length.
    """
    free: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    segments: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(space: int, a: int, b: int) -> None:
        if space and a < b:
            if space not in ranges:
                bisect.insort(free, space)
                ranges[space] = []
            ranges[space].append((a, b))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                need = -(-n // (capacity // length))
                put(capacity, opened, opened + need)
                opened += need
                continue
            space = free[i]
            a, b = ranges[space].pop()
            if not ranges[space]:
                del ranges[space]
                free.pop(i)
            fit = space // length
            whole = min(b - a, n // fit)
            if whole:
                segments.append((length, rank, rank + whole * fit, fit, a, capacity - space))
                put(space - fit * length, a, a + whole)
                a, rank, n = a + whole, rank + whole * fit, n - whole * fit
            if a < b and n and n < fit:
                segments.append((length, rank, rank + n, n, a, capacity - space))
                put(space - n * length, a, a + 1)
                a, n = a + 1, 0
            put(space, a, b)
    return segments, opened


def pack(lengths: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Assignment of items to containers: capacity_id, container_id, key, piece_no, first_token, n_tokens, offset.

    lengths: key, n_tokens. capacities: capacity_id, capacity_tokens (a small dimension: its rows are counted).
    """
    spark = lengths.sparkSession
    lengths = materialize(lengths.select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    caps = [(int(r[0]), int(r[1])) for r in capacities.select("capacity_id", "capacity_tokens").where("capacity_id is not null and capacity_tokens >= 1").distinct().limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1,000 capacities")
    if not caps:
        return spark.createDataFrame([], f"capacity_id int, container_id bigint, `{key}` {lengths.schema[0].dataType.simpleString()}, piece_no bigint, first_token bigint, n_tokens bigint, offset bigint")

    each = F.inline(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("long").alias("cap")) for i, c in caps]))
    rest, full = F.col("n_tokens") % F.col("cap"), F.floor(F.col("n_tokens") / F.col("cap"))
    kinds = F.array_compact(F.array(
        F.when(F.col("n_tokens") == 0, F.struct(F.lit(NONE).alias("kind"), F.lit(0).cast("long").alias("size"))),
        F.when(full > 0, F.struct(F.lit(FULL).alias("kind"), full.alias("size"))),
        F.when(rest > 0, F.struct(F.lit(REST).alias("kind"), rest.alias("size"))),
    ))
    # lengths up to the capacity and numbers of full pieces: as many rows as there are different values of them
    counted = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).select("n_tokens", "n", each).select("capacity_id", "n", F.inline(kinds)).groupBy("capacity_id", "kind", "size").agg(F.sum("n").alias("n")).collect()
    groups, segments = [], []
    for cap_id, cap in caps:
        mine = [r for r in counted if r["capacity_id"] == cap_id]
        groups += [(cap_id, r["kind"], r["size"], -(-r["n"] // RANK_BUCKET)) for r in mine]
        plan, at = plan_best_fit({r["size"]: r["n"] for r in mine if r["kind"] == REST}, cap)
        segments += [(cap_id, REST, *s) for s in plan]
        for r in sorted((r for r in mine if r["kind"] == FULL), key=lambda r: r["size"]):
            segments.append((cap_id, FULL, r["size"], 0, r["n"], 1, at, 0))
            at += r["n"] * r["size"]
        segments += [(cap_id, NONE, 0, 0, r["n"], r["n"], 0, 0) for r in mine if r["kind"] == NONE]
    group = spark.createDataFrame(groups or [(0, 0, 0, 1)], "capacity_id int, kind int, size bigint, buckets bigint")
    plan = spark.createDataFrame(segments or [(0, 0, 0, 0, 0, 1, 0, 0)], "capacity_id int, kind int, size bigint, r0 bigint, r1 bigint, copies bigint, first bigint, base bigint")

    on = ["capacity_id", "kind", "size"]
    items = lengths.select(key, "n_tokens", each).select("capacity_id", "cap", key, "n_tokens", F.inline(kinds)).join(sized_broadcast(group), on)
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key), F.col("buckets")))
    local = F.row_number().over(Window.partitionBy(*on, "bucket").orderBy(key)) - 1
    offsets = items.groupBy(*on, "bucket").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select(*on, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    # only lengths of several buckets have offsets; the others are ranked in one
    several = offsets.where(F.col("before") > 0)
    ranked = items.withColumn("local", local).join(several, [*on, "bucket"], "left").withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(sized_broadcast(plan), on).where((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    k = F.col("rank") - F.col("r0")
    slot = F.floor(k / F.col("copies"))
    part = F.when(F.col("kind") == FULL, F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda p: F.struct(
        (F.col("first") + k * F.col("size") + p).alias("container_id"), p.alias("piece_no"), (p * F.col("cap")).alias("first_token"), F.col("cap").alias("n"), F.lit(0).cast("long").alias("offset"))))
    part = part.otherwise(F.array(F.struct(
        (F.col("first") + slot).alias("container_id"), F.floor(F.col("n_tokens") / F.col("cap")).alias("piece_no"),
        (F.col("n_tokens") - F.col("size")).alias("first_token"), F.col("size").alias("n"), (F.col("base") + (k % F.col("copies")) * F.col("size")).alias("offset"))))
    out = placed.select("capacity_id", F.col(key).alias("_key"), F.inline(part))
    return out.select("capacity_id", "container_id", F.col("_key").alias(key), "piece_no", "first_token", F.col("n").alias("n_tokens"), "offset")
