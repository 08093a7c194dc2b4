import numpy as np

from spanforge.llm import queries, reading

HARD = "Hence the norm, qua claim, is tacit; qua law, it elides the very prior it would fain deny. "
EASY = "I put the pen in the plant. We went to the chip at ten. My cup is cold and my hat is red. "


def test_prose_is_the_authors_own():
    text = f"[quote][quote]{HARD}[/quote]\nok[/quote]\nbob wrote:\n> {HARD}\nMy own words.\n```\nSELECT 1 FROM t;\n```\nsee http://a.example/b\n-- \n{HARD}\n[Edited by bob on 2024-01-01: typo]"
    assert " ".join(reading.prose(text).split()) == "My own words. see"


def test_spoilers_are_prose():
    assert reading.prose(f"[spoiler]{EASY}[/spoiler]\n-- \n{HARD}").strip() == EASY.strip()


def test_isotonic_is_increasing_and_keeps_the_mean():
    at, level = reading.isotonic(np.array([3.0, 1.0, 2.0]), np.ones(3), np.array([3.0, 2.0, 1.0]))
    assert list(at) == [1.5, 3.0] and list(level) == [1.5, 3.0]


def test_levels(spark):
    assert "p8_found" in queries.queries()
    middle = "The second window arrived on Monday, so the network will be downloaded this week. "
    docs = [(i, f"{(EASY, middle, HARD)[i % 3]}" * 3) for i in range(36)]
    docs += [(100, HARD * 3 + EASY[:28]), (101, EASY * 4 + HARD), (102, f"> {HARD * 3}\n" + EASY * 2), (103, HARD), (104, None), (105, "Настройка мне нравится. " * 20 + HARD)]
    labels = [(i, "r", i % 3 + 1, None) for i in range(30)] + [(0, "s", None, None), (None, "s", 3, None)]
    out = reading.levels(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, rater string, band int, rated_at timestamp"))
    band = {r.doc_id: r.band for r in out.collect()}
    assert {i: band[i] for i in range(36)} == {i: i % 3 + 1 for i in range(36)}
    assert (band[100], band[101], band[102]) == (3, 1, 1)
    assert not {103, 104, 105} & set(band)


def test_no_labels_no_levels(spark):
    out = reading.levels(spark.createDataFrame([(1, HARD * 3)], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, rater string, band int, rated_at timestamp"))
    assert out.collect() == []


def test_held_out_labels(spark):
    """Labels of the sf0.1 tables that the ranker has not seen: precision and recall of band 3, by the raters' majority."""
    import os

    import pytest
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "reading_labels"))
    major = labels.where("band is not null").groupBy("doc_id", "band").count().groupBy("doc_id").agg(F.max_by("band", "count").alias("true"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(7)) % 3 == 0
    out = reading.levels(docs.join(labels.select("doc_id").distinct(), "doc_id"), labels.where(~test))
    n = {(r.true, r.band): r["count"] for r in major.where(test).join(out, "doc_id", "left").groupBy("true", "band").count().collect()}
    hit = n.get((3, 3), 0)
    assert hit > 0.9 * sum(v for (t, _), v in n.items() if t == 3) and hit > 0.9 * sum(v for (_, b), v in n.items() if b == 3)
    assert sum(v for (t, b), v in n.items() if t == b) > 0.9 * sum(n.values())
