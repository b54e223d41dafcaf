"""Queries over readers and writers: decoding, keys, pruning, shards, pyramids, manifests, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks, tables
from . import fixtures as X
from .scalars import rounded
from .space import _MORTON

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, round(CASE WHEN p_size <> 13 THEN p_size * 0.1::DOUBLE - 2 END, 6) AS v FROM part")
def decode_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled integers with a reserved value."""
    return rounded(X.read(spark, sf_dir, "part").select("p_partkey", tables.decoded(F.col("p_size"), 0.1, -2.0, 13).alias("v")))


@query("SELECT event_id, CASE WHEN value < 400 AND value <> 0 THEN round(value, 6) END AS value FROM events")
def missing_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill values and sentinels as null at the scan (S6, data model)."""
    return rounded(tables.missing_to_null(X.read(spark, sf_dir, "events").select("event_id", "value"), {"value": 0.0}, over=400))


@query("WITH k AS (SELECT p_partkey, 'data/model' || (p_partkey % 9) || CASE p_partkey % 3 WHEN 0 THEN '_ssp245_2041-2060.nc' WHEN 1 THEN '-rcp85_2080s.tif' ELSE '_ssp370_2081_2100.nc' END AS key FROM part) SELECT p_partkey, 'model' || (p_partkey % 9) AS label, CASE p_partkey % 3 WHEN 0 THEN 'ssp245' WHEN 1 THEN 'rcp85' ELSE 'ssp370' END AS scenario, CASE p_partkey % 3 WHEN 0 THEN '2041-2060' WHEN 1 THEN '2080s' ELSE '2081-2100' END AS period FROM k")
def product_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, scenario and period from object keys."""
    n = F.col("p_partkey")
    key = F.concat(F.lit("data/model"), (n % 9).cast("string"), F.when(n % 3 == 0, "_ssp245_2041-2060.nc").when(n % 3 == 1, "-rcp85_2080s.tif").otherwise("_ssp370_2081_2100.nc"))
    return X.read(spark, sf_dir, "part").select("p_partkey", tables.product_key(key).alias("k")).select("p_partkey", "k.*")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 3) AND l_quantity >= 40 AND (l_discount IS NULL OR l_discount <= 0.05::DOUBLE)")
def pushed_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed condition that the scan takes."""
    test = tables.predicate(equals={"l_returnflag": "R"}, within={"l_linenumber": [1, 3]}, least={"l_quantity": 40.0}, most_or_null={"l_discount": 0.05})
    return X.read(spark, sf_dir, "lineitem").where(test).select("l_orderkey", "l_linenumber")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS gbifid, o_orderpriority AS datasetkey, CAST(year(o_orderdate) AS INT) AS year, CAST(NULL AS DOUBLE) AS decimallatitude FROM orders")
def conformed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name whatever their case, absent ones as null."""
    o = X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gbifID"), F.col("o_orderpriority").alias("datasetKey"), F.year("o_orderdate").alias("YEAR"))
    return tables.conformed(o, tables.OCCURRENCE).select("gbifid", "datasetkey", "year", "decimallatitude")


@query(f"WITH {X.PLACES_SQL}, p AS (SELECT place_id, country, CAST(floor((lon + 180) * 100) AS BIGINT) AS x, CAST(floor((lat + 90) * 100) AS BIGINT) AS y FROM places), z AS (SELECT place_id, country, {_MORTON} | " + " | ".join(f"((((x >> {k}) & 1) << {2 * k}) | (((y >> {k}) & 1) << {2 * k + 1}))" for k in range(12, 16)) + " AS z FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY z, place_id) - 1 AS k, count(*) OVER (PARTITION BY country) AS n FROM z), s AS (SELECT *, CAST(floor(k * ceil(n / 20) / n) AS INT) AS shard FROM r) SELECT place_id, country, shard, CAST(row_number() OVER (PARTITION BY country, shard ORDER BY z, place_id) - 1 AS INT) AS slot FROM s")
def even_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even shards of a country along the curve, with slots."""
    return sinks.sharded(X.places(spark, sf_dir), "country", 20).select("place_id", "country", "shard", "slot")


@query(f"WITH {X.CELLS_SQL}, q AS (SELECT grid_row, grid_col, CAST(CASE WHEN score >= 0.5::DOUBLE THEN least(44 + floor((score - 0.5::DOUBLE) / 0.5::DOUBLE * 84), 127) ELSE least(floor(score / 0.5::DOUBLE * 44), 43) END AS INT) AS code FROM cells), l AS (SELECT unnest([1, 2, 4, 8]) AS factor), p AS (SELECT factor, CAST(grid_row // factor AS INT) AS r, CAST(grid_col // factor AS INT) AS c, max(code) AS code FROM q, l GROUP BY 1, 2, 3) SELECT factor, r, c, code, CAST(CASE WHEN code < 44 THEN 0 ELSE 1 + least(2, floor((code - 44) * 3 / 84)) END AS INT) AS lite FROM p")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the largest codes and their classes."""
    from ..functions.climate import quantised

    return sinks.pyramid(X.cells(spark, sf_dir).select("grid_row", "grid_col", quantised(F.col("score"), F.lit(0.5)).alias("code")))


@query()
def manifest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and checksums of a table's parts."""
    return sinks.manifest(X.cells(spark, sf_dir), "species")


@query("WITH e AS (SELECT s_name AS label, s_nationkey AS country FROM supplier WHERE s_acctbal < 5000) SELECT label, country FROM e UNION ALL SELECT s_name, s_nationkey FROM supplier WHERE s_acctbal > 2000 AND s_name NOT IN (SELECT label FROM e)")
def append_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows whose label isn't there yet."""
    s = X.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("label"), F.col("s_nationkey").alias("country"), "s_suppkey")
    pick = lambda test: s.where(test).drop("s_suppkey")
    return sinks.appended(pick("s_acctbal < 5000"), pick("s_acctbal > 2000"), "label")


@query(f"WITH {X.CELLS_SQL} SELECT 'r' || (grid_row // 1080) || 'c' || (grid_col // 2160) AS tile, count(*) AS n, round(sum(km2), 6) AS km2 FROM cells GROUP BY 1")
def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by storage tile."""
    c = X.cells(spark, sf_dir)
    return rounded(c.groupBy(tables.tile_of(F.col("grid_row"), F.col("grid_col")).alias("tile")).agg(F.count("*").alias("n"), F.sum("km2").alias("km2")))


@query(f"WITH {X.CELLS_SQL} SELECT grid_row, grid_col, round(max(CAST(floor(score * 20000) AS INT) - 5000) * 0.01::DOUBLE, 6) AS value FROM cells GROUP BY 1, 2")
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written to binary pages and read again (K3, K11, S27, S28); a task holds one page."""
    import numpy as np
    import pandas as pd

    from ..functions.packed import SIDE, pack_page, unpack_page

    value = (F.floor(F.col("score") * 20_000) - 5_000).cast("int")
    c = X.cells(spark, sf_dir).groupBy("grid_row", "grid_col").agg(F.max(value).alias("value"))
    c = c.withColumn("r", F.floor(F.col("grid_row") / SIDE).cast("int")).withColumn("c", F.floor(F.col("grid_col") / SIDE).cast("int"))

    def write(page: pd.DataFrame) -> pd.DataFrame:
        slots = (page.grid_row % SIDE * SIDE + page.grid_col % SIDE).to_numpy()
        return pd.DataFrame({"r": page.r[:1], "c": page.c[:1], "page": [pack_page(slots, page.value.to_numpy(), 0.01)]})

    def read(frames):
        for frame in frames:
            for r, col, page in frame.itertuples(index=False):
                slots, values = unpack_page(page)
                yield pd.DataFrame({"grid_row": (slots // SIDE + r * SIDE).astype(np.int32), "grid_col": (slots % SIDE + col * SIDE).astype(np.int32), "value": values})

    pages = c.groupBy("r", "c").applyInPandas(write, "r int, c int, page binary")
    return rounded(pages.mapInPandas(read, "grid_row int, grid_col int, value double"))


@query(f"WITH {X.CLIMATE_SQL}, d AS (SELECT place_id, CAST(m AS INT) AS m, round(dtx * 8) / 8 AS d FROM climate) SELECT place_id, m, d FROM d")
def half_precision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in eighths of a degree, kept as half-precision numbers without loss (K8)."""
    from ..functions.packed import halves

    def kept(frames):
        for frame in frames:
            yield frame.assign(d=halves(frame.d.to_numpy()))

    c = X.climate_long(spark, sf_dir, changes=True).select("place_id", "m", (F.round(F.col("dtx") * 8) / 8).alias("d"))
    return c.mapInPandas(kept, c.schema)


@query(f"WITH {X.CLIMATE_SQL}, c AS (SELECT place_id, country, avg(dtx) AS tx, sum(rp) AS rp FROM climate GROUP BY 1, 2), r AS (SELECT *, ntile(4) OVER (PARTITION BY country ORDER BY place_id) AS shard FROM c) SELECT country, CAST(shard AS INT) AS shard, count(*) AS places, round(avg(tx), 6) AS tx, round(avg(rp), 6) AS rp FROM r WHERE shard < 3 GROUP BY 1, 2")
def place_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the places of some shards, read from a table that is written by shard."""
    from pyspark.sql import Window

    c = X.climate(spark, sf_dir, changes=True).select("place_id", "country", F.aggregate("dtx", F.lit(0.0), lambda a, b: a + b).alias("tx"), F.aggregate("rp", F.lit(0.0), lambda a, b: a + b).alias("rp"))
    shard = F.ntile(4).over(Window.partitionBy("country").orderBy("place_id"))
    return rounded(c.withColumn("shard", shard).where("shard < 3").groupBy("country", "shard").agg(F.count("*").alias("places"), F.avg(F.col("tx") / 12).alias("tx"), F.avg("rp").alias("rp")))
