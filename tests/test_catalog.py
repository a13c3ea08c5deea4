"""Every query of the catalogue against its DuckDB equivalent on the smallest tables."""

import math
import os

import pytest

from corpusloom import catalog

ROOT = os.environ.get("CORPUSLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(int(v)) if isinstance(v, bool) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, ROOT)
    mine = got.collect()
    if name not in catalog.ORACLE:
        assert mine
        return
    duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, mine) == rows_of(names, duck.fetchall())
