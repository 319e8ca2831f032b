from __future__ import annotations

import math

import duckdb
import pytest

from latticework.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    d.sql("SET timezone = 'UTC'")
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return d


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df, want = QUERIES[name](spark, sf), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
