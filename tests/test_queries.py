"""Every query with SQL equals DuckDB's rows on the same tables; the others run and have rows."""

import collections
import glob
import math
import os

import duckdb
import pytest

from isocline.plans import registry

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cur = db.execute(registry.ORACLE_SQL[name])
    names = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(names) == columns
    order = [list(names).index(c) for c in columns]
    want = collections.Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert got == want
    assert all(KINDS.get(t, names[c]) == names[c] for c, t in df.dtypes)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
