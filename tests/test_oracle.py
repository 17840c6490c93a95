"""Every query of the library with SQL, compared with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gristmill.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(got, df.columns) == canon(cur.fetchall(), names)
