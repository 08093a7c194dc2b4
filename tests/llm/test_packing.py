from collections import defaultdict

import numpy as np
import pytest

from spanforge.llm import packing


def _check(rows, items, caps):
    """Every token of every item lies in exactly one piece, no pieces of a container overlap, none exceeds it."""
    for cap_id, cap in caps.items():
        mine = [r for r in rows if r.capacity_id == cap_id]
        spans, inside = defaultdict(list), defaultdict(list)
        for r in mine:
            assert 0 <= r.offset and r.offset + r.n_tokens <= cap
            spans[r.doc_id].append((r.first_token, r.first_token + r.n_tokens))
            if r.n_tokens:
                inside[r.container_id].append((r.offset, r.offset + r.n_tokens))
        assert set(spans) == set(items)
        for doc, n in items.items():
            s = sorted(spans[doc])
            assert s[0][0] == 0 and s[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
            assert len(s) == max(1, -(-(n or 0) // cap))
        for s in map(sorted, inside.values()):
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        yield cap_id, len(inside)


@pytest.mark.parametrize("bucket", [packing.RANK_BUCKET, 7])
def test_assignment(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "RANK_BUCKET", bucket)  # a hot length in many buckets
    rng = np.random.default_rng(5)
    lengths = [None, 0, 1, 64, 65, 640, 1000] + [20] * 90 + rng.integers(1, 90, 200).tolist()
    items = {i: None if n is None else int(n) for i, n in enumerate(lengths)}
    df = spark.createDataFrame([(i, n, 1) for i, n in items.items()], "doc_id bigint, n_tokens bigint, rank int")
    caps = spark.createDataFrame([(1, 64, "a"), (2, 100, None), (3, None, "x"), (None, 5, "x"), (4, 0, "x"), (1, 64, "copy")], "capacity_id int, capacity_tokens int, note string")
    rows = packing.pack(df, caps).collect()
    assert {r.capacity_id for r in rows} == {1, 2}
    total = sum(n or 0 for n in items.values())
    for cap_id, n in _check(rows, items, {1: 64, 2: 100}):
        assert n <= total / {1: 64, 2: 100}[cap_id] * 1.05 + 1


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    caps = spark.createDataFrame([(1, 64)], "capacity_id int, capacity_tokens int")
    assert packing.pack(df, caps).collect() == []
    assert packing.pack(spark.createDataFrame([(1, 2)], "doc_id bigint, n_tokens bigint"), caps.where("false")).collect() == []


def test_plan_of_many_items_is_fast_and_tight():
    rng = np.random.default_rng(1)
    v, c = np.unique(np.clip(rng.lognormal(5.5, 1, 200_000), 1, 2048).astype(int), return_counts=True)
    segments, n = packing.plan_best_fit({int(a): int(b) * 1000 for a, b in zip(v, c)}, 2048)
    assert (v * c).sum() * 1000 / (n * 2048) > 0.99 and len(segments) < 50_000
