import importlib

import pytest

from tests.compare import SF, assert_same

MODULES = ["training", "intervals", "variants", "copynumber", "genomics", "io", "sequences", "pipelines"]
BOOKS = [importlib.import_module(f"spanforge.plans.{m}") for m in MODULES]
QUERIES = {k: v for b in BOOKS for k, v in b.queries().items()}
SQL = {k: v for b in BOOKS for k, v in b.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_without_llm(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_LLM", "spanforge.llm.no_such_module")
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(SQL)
