"""Every query with SQL against DuckDB on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.conftest import normal

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["src_id", "ref_id", "kind", "beg_pos", "end_pos"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    ours = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    theirs_cols = [d[0] for d in cur.description]
    assert sorted(theirs_cols) == cols
    at = [theirs_cols.index(c) for c in cols]
    assert ours == sorted(tuple(normal(r[i]) for i in at) for r in cur.fetchall())
