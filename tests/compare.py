"""Comparing a query with its SQL over the same tables."""

import glob
import os

import duckdb

SF = os.environ.get("SPANFORGE_TEST_SF", "/root/testdata/sf0.001")


def _cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.7g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(sql)
    names, expected = _rows([d[0] for d in want.description], want.fetchall())
    df = query(spark, sf)
    cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert cols == names
    assert len(got) == len(expected)
    assert [x for x in zip(got, expected) if x[0] != x[1]][:3] == []
