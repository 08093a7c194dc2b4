import random

from spanforge.functions import alleles as a
from pyspark.sql import functions as F


def _apply(text, pos, ref, alt):
    assert text[pos : pos + len(ref)] == ref
    return text[:pos] + alt + text[pos + len(ref) :]


def test_equivalents_give_the_same_sequence(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        text = "".join(rng.choice("AC") for _ in range(40))
        p, k = rng.randint(5, 25), rng.randint(1, 4)
        if i % 2:
            ref, alt = text[p], text[p] + "".join(rng.choice("AC") for _ in range(k))
        else:
            ref, alt = text[p : p + k + 1], text[p]
        rows.append((i, text, p, ref, alt, text[: p + 1], text[p + len(ref) :]))
    c = [F.col(x) for x in ("pos", "ref", "alt")]
    df = spark.createDataFrame(rows, "id int, text string, pos int, ref string, alt string, before string, after string")
    out = df.select("*", a.equivalents(*c, F.col("before"), F.col("after")).alias("e"), a.shift_left(*c, F.col("before")).alias("l"), a.shift_right(*c, F.col("after")).alias("r")).collect()
    for r in out:
        want = _apply(r.text, r.pos, r.ref, r.alt)
        k = len(r.ref) - len(r.alt)
        every = {(q, r.text[q : q + max(k, 0) + 1], r.text[q] + (want[q + 1 : q + 1 - k] if k < 0 else "")) for q in range(40 - max(k, 0)) if _apply(r.text, q, r.text[q : q + max(k, 0) + 1], r.text[q] + (want[q + 1 : q + 1 - k] if k < 0 else "")) == want}
        got = [tuple(x) for x in r.e]
        assert set(got) == every and len(got) == len(every)
        assert (r.l.pos, r.r.pos) == (got[0][0], got[-1][0]) and (r.l.ref, r.l.alt) == got[0][1:]


def test_parsimonious_cases(spark):
    cases = {("GAT", "GAT"): (5, "G", "G"), ("GGA", "GGTA"): (6, "G", "GT"), ("CAT", "GAT"): (5, "C", "G"), ("AT", "T"): (4, "NA", "N"), ("TAT", "T"): (5, "TAT", "T"), ("ACGT", "AGGT"): (6, "C", "G")}
    rows = [(r, x) for r, x in cases] + [(None, "A"), ("A", None)]
    got = {(r.ref, r.alt): r.p for r in spark.createDataFrame(rows, "ref string, alt string").select("*", a.parsimonious(F.lit(5), F.col("ref"), F.col("alt")).alias("p")).collect()}
    assert {k: tuple(v) for k, v in got.items() if v} == cases


def test_types_and_names(spark):
    rows = [("A", "T", "snv", "1:g.7A>T"), ("AC", "GT", "mnv", "1:g.7_8delinsGT"), ("A", "AG", "ins", "1:g.7_8insG"), ("AG", "A", "del", "1:g.8del"), ("A", "TG", "delins", "1:g.7delinsTG"), ("A", "<DEL:ME>", "sv", None), ("A", "]2:9]A", "sv", None),
            ("A", "*", "overlap_del", None), ("CG", "<CPGMET>", "cpgmet", None), ("A", "<X>", "unknown", None), ("A", None, None, None)]
    df = spark.createDataFrame([(r, x) for r, x, *_ in rows], "ref string, alt string")
    got = df.select(a.mutation_type(F.col("ref"), F.col("alt")), a.hgvsg(F.lit("1"), F.lit(7), F.col("ref"), F.col("alt"))).collect()
    assert [tuple(r) for r in got] == [(t, h) for *_, t, h in rows]
