"""The operators' queries against their SQL on the smallest driver tables."""

import os

import pytest

from cuelake.llm import queries

from ..test_oracles import DIR, duck, plain  # noqa: F401  (the fixture)

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.ORACLE_SQL[name])
    names, columns = [d[0] for d in want.description], sorted(df.columns)
    assert sorted(names) == columns
    rows = [[r[names.index(c)] for c in columns] for r in want.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(rows)
