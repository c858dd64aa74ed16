import pytest

import __spark_entry__ as entry
from spanloom.plans import oracles, queries
from tests.oracle import connect, rows


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    got = queries.queries()[name](spark, data)
    want = connect(data).sql(oracles.oracle_sql()[name])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {f.name: kinds[f.dataType.simpleString()] for f in got.schema} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.toPandas()) == rows(want.df())


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["token_map", "text_audit", "audit_signals"])
def test_matching_queries_run(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0
