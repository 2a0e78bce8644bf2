"""Each query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from cuelake import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return int(x) if isinstance(x, bool) else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [[r[names.index(c)] for c in columns] for r in want.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(rows)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
