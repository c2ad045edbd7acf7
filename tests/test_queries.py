"""Every query agrees with its SQL."""

import pytest

from conftest import DATA, same_rows
from tessera.plans import queries, queries_builders, queries_corpora, queries_functions, queries_shaping, queries_truth  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, oracle, name):
    same_rows(queries.QUERIES[name](spark, DATA), oracle.execute(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_training_data_operators(spark, monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES)
