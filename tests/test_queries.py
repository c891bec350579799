"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from annalist.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or hasattr(x, "as_tuple"):
        return f"{float(x):.6f}"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.collect(), df.columns) == table(want.fetchall(), want.columns)
