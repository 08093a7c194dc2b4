import pytest

from spanforge.operators.packed_values import split_packed

CASES = {
    None: [], "": [], "  ": [], "a": [(1, "a")], "N/A": [], "n/a": [], "a/b": [(1, "a"), (2, "b")], "a&N/A": [(1, "a")], "N/A,b": [(2, "b")],
    "a&&b": [(1, "a"), (3, "b")], '"x,y",z': [(1, "x,y"), (2, "z")], '"a ""b""";c': [(1, 'a "b"'), (2, "c")], "[a, b]": [(1, "a"), (2, "b")],
    "A::B,C": [(1, "A::B"), (2, "C")], "a%2Cb": [(1, "a"), (2, "b")], r"a\,b,c": [(1, r"a\,b"), (2, "c")], "., -,a": [(3, "a")], '"open,b': [(1, '"open'), (2, "b")],
    "xN/A": [(1, "xN"), (2, "A")],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, v, i) for i, v in enumerate(CASES)] * 2 + [(None, "p|q", 0)]
    df = spark.createDataFrame(rows, "k bigint, f string, item bigint")
    return {(r.k, r.pos): r.item for r in split_packed(df, ["k"], ["f"]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    want = list(CASES.values())[i]
    assert sorted((p, x) for (k, p), x in found.items() if k == i) == want


def test_null_keys_long_texts_and_empty_tables(spark, found):
    assert [x for (k, _), x in sorted(found.items(), key=lambda y: str(y)) if k is None] == ["p", "q"]
    long = spark.createDataFrame([(1, ",".join(f"v{i}" for i in range(3000)))], "k bigint, f string")
    assert split_packed(long, ["k"], ["f"], 2).count() == 3000
    assert split_packed(long.where("false"), ["k"], ["f"]).collect() == []
