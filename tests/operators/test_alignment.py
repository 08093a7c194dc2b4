import random

import pytest

from spanforge.functions import alignment as al


def test_variants_rebuild_the_query():
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(6, 20)))
        b = a[:2] + "".join(c for c in a[2:-2] if rng.random() > 0.15) + a[-2:]
        b = "".join(c if 1 < i < len(b) - 2 and rng.random() < 0.8 or i < 2 or i >= len(b) - 2 else rng.choice(["", "A", c + "T"]) for i, c in enumerate(b))
        t, q, _ = al.align(a, b)
        assert t.replace("-", "") == a and q.replace("-", "") == b
        if t[0] == "-" or q[0] == "-" or q[-1] == "-":
            continue
        text = a
        for pos, ref, alt in sorted(al.variants(t, q, 100), reverse=True):
            assert text[pos - 100 : pos - 100 + len(ref)] == ref
            text = text[: pos - 100] + alt + text[pos - 100 + len(ref) :]
        assert text == b


def test_flanking_gaps_and_kinds():
    assert al.variants("ACGTA", "--GTA", 10) == [] and al.variants("ACGTA", "ACC--", 10) == [(12, "G", "C")]
    assert al.variants("AC-GT", "ACTGT", 0) == [(1, "C", "CT")] and al.variants("ACCT", "A--T", 0) == [(0, "ACC", "A")]
    assert al.variants("AC-T", "A-GT", 5) == [(6, "C", "G")] and al.variants("", "", 0) == []


def test_best_of_equals():
    assert al.best([("AAC", "A-C"), ("AAC", "-AC")]) == ("AAC", "-AC")
    assert al.best([("A-C", "AGC"), ("AC--", "--AC")]) == ("A-C", "AGC")
    with pytest.raises(ValueError):
        al.best([("AA", "-A"), ("AA", "-A")])


def test_cigar_parts():
    ops = [("S", 2), ("M", 10), ("I", 1), ("M", 5), ("D", 3), ("M", 4)]
    assert al.split_cigar(ops, 100, 105, 116) == ([("S", 2), ("M", 5)], [("M", 5), ("I", 1), ("M", 5), ("D", 1)], [("D", 2), ("M", 4)])
    assert al.split_cigar(ops, 100, 0, 1000) == ([], ops, [])


def test_groups():
    assert al.groups(["ACGTACGT", "TTTTGGGG", "ACGTACG", "ACGAACGT"]) == [0, 1, 0, 0] and al.groups([]) == []
