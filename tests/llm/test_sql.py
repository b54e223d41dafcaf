import collections
import glob
import os

import duckdb
import pytest

from isocline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf)
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda v: tuple(v) if isinstance(v, list) else v
    want = collections.Counter(tuple(map(key, r)) for r in cur.fetchall())
    assert collections.Counter(tuple(map(key, r)) for r in df.select(*names).collect()) == want
