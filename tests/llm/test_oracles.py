"""The queries that SQL can state, against DuckDB on the smallest tables."""

import os

import pytest

from corpusloom.llm import queries

ROOT = os.environ.get("CORPUSLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    c.execute(queries.ORACLE[name])
    names = [d[0] for d in c.description]
    got = queries.QUERIES[name](spark, ROOT)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(r[n] for n in order) for r in got.collect())
    theirs = sorted(tuple(r[names.index(n)] for n in order) for r in c.fetchall())
    assert mine == theirs
