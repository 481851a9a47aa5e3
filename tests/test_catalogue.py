"""Every query of the catalogue against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from glossa import queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, str(FOLDER))
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(queries.queries())
