"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from callmetrics.plans import dashboard_queries, evaluation_queries, measure_queries, package_queries, registry, scalar_queries, stream_queries, trace_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "is_integer") or isinstance(value, int):
        return round(float(value), 6)
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SMALL)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).limit(1).count() == 1
