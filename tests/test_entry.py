"""The registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from runloom import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    left = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    right = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 802 and set(queries.QUERIES) <= set(entry.queries())
