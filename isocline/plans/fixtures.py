"""Tables that the queries derive from the driver's: places, monthly climates, cells, routes, scores.

Each column is one expression that Spark and DuckDB both read, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M = re.compile(r"\bm\b")
# Expressions over `customer`: a place for each.
PLACES = {
    "place_id": "c_custkey",
    "label": "c_name",
    "country": "c_nationkey",
    "lat": "(c_custkey * 37 % 1100) / CAST(10 AS DOUBLE) - 55",
    "lon": "(c_custkey * 911 % 3600) / CAST(10 AS DOUBLE) - 180",
    "pop": "CAST(floor(abs(c_acctbal) * 100) AS BIGINT)",
}
# Expressions over places and months m from 1: a monthly climate.
MONTHS = {
    "tmax": "12 + 13 * sin((m - 4) * CAST(0.5235987755982988 AS DOUBLE)) + (place_id % 23) - 11",
    "tmin": "12 + 13 * sin((m - 4) * CAST(0.5235987755982988 AS DOUBLE)) + (place_id % 23) - 17 - (place_id % 7)",
    "ppt": "CAST((place_id * 7 + m * m * 11) % 173 * (place_id % 4) AS DOUBLE) / 2",
    "vap": "CAST(0.4 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (30 + (place_id * m) % 19)",
}
# Expressions over places and months: a model's change.
CHANGES = {
    "dtx": "(place_id * m % 60) / CAST(10 AS DOUBLE) - 1",
    "dtn": "(place_id * (m + 3) % 50) / CAST(10 AS DOUBLE)",
    "rp": "(place_id * (m + 5) % 70) / CAST(10 AS DOUBLE)",
    "rv": "CASE WHEN place_id % 5 = 0 THEN NULL ELSE CAST(0.4 AS DOUBLE) + (place_id * m % 30) / CAST(10 AS DOUBLE) END",
}
# Expressions over `part`: cells of a grid with a predictor, a score and two states.
CELLS = {
    "cell_id": "p_partkey",
    "grid_row": "CAST(p_partkey * 13 % 300 + 800 AS INT)",
    "grid_col": "CAST(p_partkey * 29 % 400 + 1900 AS INT)",
    "lat": "90 - (p_partkey * 13 % 300 + 800 + CAST(0.5 AS DOUBLE)) / 24",
    "lon": "-180 + (p_partkey * 29 % 400 + 1900 + CAST(0.5 AS DOUBLE)) / 24",
    "km2": "CAST(10 AS DOUBLE) + p_partkey % 12",
    "score": "(p_partkey * 7919 % 1000) / CAST(1000 AS DOUBLE)",
    "now": "p_partkey * 13 % 300 > 120 AND p_partkey % 3 < 2",
    "later": "p_partkey * 13 % 300 < 200 AND p_partkey % 5 < 3",
    "species": "p_brand",
}
# Expressions over `lineitem`: occurrence records.
RECORDS = {
    "record_id": "l_orderkey * 10 + l_linenumber",
    "lat": "CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 0 ELSE (l_partkey * 37 % 1100) / CAST(10 AS DOUBLE) - 55 END",
    "lon": "CASE WHEN l_partkey % 89 = 0 THEN 0 ELSE (l_partkey * 911 % 3600) / CAST(10 AS DOUBLE) - 180 END",
    "uncertainty": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey * 700 % 20000 AS DOUBLE) END",
    "established": "CASE l_partkey % 6 WHEN 0 THEN 'managed' WHEN 1 THEN 'Introduced: naturalised' WHEN 2 THEN NULL ELSE 'NATIVE' END",
    "year": "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(1965 + l_orderkey % 60 AS INT) END",
    "month": "CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(1 + l_orderkey % 12 AS INT) END",
    "dataset": "CAST(l_suppkey % 5 AS INT)",
    "licence": "l_returnflag",
    "identity": "l_orderkey * 3 + l_linenumber % 3",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(read(spark, sf_dir, "customer"), PLACES)


def climate(spark: SparkSession, sf_dir: str, changes: bool = False) -> DataFrame:
    """A row for each place, with arrays of twelve months."""
    out = places(spark, sf_dir)
    for name, text in {**MONTHS, **(CHANGES if changes else {})}.items():
        out = out.withColumn(name, F.expr(f"array({', '.join(_M.sub(str(m), text) for m in range(1, 13))})"))
    return out


def climate_long(spark: SparkSession, sf_dir: str, changes: bool = False) -> DataFrame:
    """A row for each place and month."""
    base = places(spark, sf_dir).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return base.selectExpr("*", *[f"{e} AS {n}" for n, e in {**MONTHS, **(CHANGES if changes else {})}.items()])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(read(spark, sf_dir, "part"), CELLS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(read(spark, sf_dir, "lineitem"), RECORDS)


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


PLACES_SQL = f"places AS ({_select(PLACES, 'customer')})"
CLIMATE_SQL = f"{PLACES_SQL}, climate AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in {**MONTHS, **CHANGES}.items()) + " FROM places, (SELECT CAST(unnest(range(1, 13)) AS INT) AS m))"
CELLS_SQL = f"cells AS ({_select(CELLS, 'part')})"
RECORDS_SQL = f"records AS ({_select(RECORDS, 'lineitem')})"
