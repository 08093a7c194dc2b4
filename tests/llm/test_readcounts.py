from spanforge.llm import quantiles, queries


def test_readcount_digests_merge(spark, tmp_path):
    rows = [(v, s, {0: v, 1: None if v % 2 else 5}) for s in ("a", "b") for v in range(1, 11)]
    rows += rows[:3] + [(50, "b", None), (51, "b", {})]
    spark.createDataFrame(rows, "variant_id bigint, sample string, rppcounts map<int,bigint>").write.parquet(f"{tmp_path}/readstats.parquet")
    q = queries.queries()
    digests = q["p1_readcount_digests"](spark, str(tmp_path))
    assert digests.columns == ["sample", "allele_class", "nodes", "counts"]
    both = digests.unionByName(digests)  # two loads
    merged = quantiles.percentiles(quantiles.merge(both, ["sample", "allele_class"]), ["sample", "allele_class"], {"p50": 0.5}, queries.COUNT_STEP)
    assert {(r.sample, r.allele_class): (r.n, r.p50) for r in merged.collect()} == {(s, c): v for s in "ab" for c, v in ((0, (20, 5.0)), (1, (10, 5.0)))}
    all_samples = {r.allele_class: (r.n, r.p10, r.p50, r.p99) for r in q["p1_readcount_all_samples"](spark, str(tmp_path)).collect()}
    assert all_samples == {0: (20, 1.0, 5.0, 10.0), 1: (10, 5.0, 5.0, 5.0)}
