"""Queries over look-ups and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..operators import lookup as L
from . import fixtures as X
from .scalars import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {X.PLACES_SQL} SELECT place_id, lat FROM places WHERE pop % 100 / 100::DOUBLE >= 0.25::DOUBLE AND lat * 1.2::DOUBLE > -60 AND 1 / nullif(place_id % 13, 0)::DOUBLE IS NOT NULL")
def usable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with enough land, beyond the latitude, with a finite value (F8)."""
    g = config()["grid"]
    p = X.places(spark, sf_dir).withColumn("value", F.when(F.col("place_id") % 13 != 0, 1 / (F.col("place_id") % 13)))
    return L.usable(p, F.col("pop") % 100 / 100, F.col("lat") * 1.2, ["value"], g["land_fraction"], g["min_lat"]).select("place_id", "lat")


@query("SELECT l_orderkey AS plot, l_partkey AS species, count(*) AS trees FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 5 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY 1, 2")
def live_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live trees of listed species on listed plots."""
    trees = X.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plot"), F.col("l_partkey").alias("species"), F.col("l_quantity").alias("diameter"), (F.col("l_linestatus") == "F").alias("alive"))
    plots = X.read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("plot"))
    species = X.read(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("species"))
    return L.live_trees(trees, plots, species, 5).groupBy("plot", "species").agg(F.count("*").alias("trees"))


@query(f"WITH {X.PLACES_SQL} SELECT place_id, label, country, pop FROM places WHERE starts_with(lower(trim(label)), 'customer#00000') ORDER BY (country = 3) DESC, (lower(trim(label)) = 'customer#00000') DESC, pop DESC, label LIMIT 12")
def gazetteer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by region hit, exact name and population (T4): a report of twelve."""
    return L.gazetteer_rank(X.places(spark, sf_dir), "Customer#00000", 3, 12).select("place_id", "label", "country", "pop")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(trim(replace(c_name, 'Customer', ' SPECIES'))) = lower(trim(replace(s_name, 'Supplier', 'species  '[1:7])))")
def evidence_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence joined on the trimmed lower-case common name."""
    a = X.read(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace("c_name", "Customer", " SPECIES").alias("name"))
    b = X.read(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "Supplier", "species").alias("name"))
    return L.by_common_name(a, b, "name").select("c_custkey", "s_suppkey")


_SOURCES = "s AS (SELECT o_custkey AS place, (['own', 'regional', 'global'])[CAST(o_orderpriority[1] AS INT) % 3 + 1] AS source, CASE WHEN year(o_orderdate) < 1996 THEN 'mid' ELSE 'late' END AS period, o_totalprice AS value, o_orderkey FROM orders)"


@query(f"WITH {_SOURCES}, v AS (SELECT place, source, period, max(value) AS value FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CASE source WHEN 'own' THEN 1 WHEN 'regional' THEN 2 ELSE 3 END) AS n FROM v WHERE period = 'mid') SELECT place, source, round(value, 2) AS value FROM r WHERE n = 1")
def change_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has the period; others are refused (H8)."""
    source = F.element_at(F.array(*map(F.lit, ("own", "regional", "global"))), F.substring("o_orderpriority", 1, 1).cast("int") % 3 + 1)
    s = X.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), source.alias("source"), F.when(F.year("o_orderdate") < 1996, "mid").otherwise("late").alias("period"), F.col("o_totalprice").alias("value"))
    v = s.groupBy("place", "source", "period").agg(F.max("value").alias("value"))
    return L.first_source(v, ["place"], ["own", "regional", "global"], "mid").select("place", "source", F.round("value", 2).alias("value"))


@query("WITH w AS (SELECT s_nationkey AS place, l_suppkey % 8 AS model, year(l_shipdate) - 1992 + (l_suppkey % 8) / 8::DOUBLE AS warming, avg(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), f AS (SELECT place, model, level, min_by(value, warming) AS value FROM w, (VALUES (1.5::DOUBLE), (3.0::DOUBLE), (6.5::DOUBLE)) t(level) WHERE warming >= level GROUP BY 1, 2, 3) SELECT place, level, count(*) AS models, round(median(value), 6) AS median FROM f GROUP BY 1, 2 HAVING count(*) >= 3")
def warming_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at warming levels over the models that reach them, offered where three do."""
    li = X.read(spark, sf_dir, "lineitem").join(X.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    model = F.col("l_suppkey") % 8
    w = li.groupBy(F.col("s_nationkey").alias("place"), model.alias("model"), (F.year("l_shipdate") - 1992 + model / 8).alias("warming")).agg(F.avg("l_quantity").alias("value"))
    return rounded(L.levels_reached(w, ["place"], [1.5, 3.0, 6.5]))


@query("SELECT o_custkey AS place, round(avg(CASE WHEN o_totalprice > 50000 THEN o_totalprice END), 4) AS normal, count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1996 GROUP BY 1")
def normals_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals over a range of years, missing values ignored (H4)."""
    value = F.when(F.col("o_totalprice") > 50_000, F.col("o_totalprice"))
    o = X.read(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1993, 1996))
    return o.groupBy(F.col("o_custkey").alias("place")).agg(F.round(F.avg(value), 4).alias("normal"), F.count(value).alias("n"))


@query("SELECT place, y, round(sum(high), 4) AS high, round(sum(low), 4) AS low, round(sum(ppt), 4) AS ppt FROM (SELECT o_custkey AS place, year(o_orderdate) AS y, o_totalprice AS high, NULL AS low, NULL AS ppt FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, year(o_orderdate), NULL, o_totalprice / 2, o_totalprice / 4 FROM orders WHERE o_orderstatus = 'O') GROUP BY 1, 2")
def partial_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have only some measures, put together with the others null (H1)."""
    o = X.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus", "o_totalprice")
    a = o.where("o_orderstatus = 'F'").select("place", "y", F.col("o_totalprice").alias("high"))
    b = o.where("o_orderstatus = 'O'").select("place", "y", (F.col("o_totalprice") / 2).alias("low"), (F.col("o_totalprice") / 4).alias("ppt"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("place", "y").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("high", "low", "ppt")])


@query(f"WITH {X.CELLS_SQL} SELECT CAST(grid_row // 10 AS BIGINT) AS r, CAST(grid_col // 10 AS BIGINT) AS c, round(avg(score), 6) AS mean, count(*) FILTER (score < 0.25) AS bin0, count(*) FILTER (score >= 0.25 AND score < 0.5) AS bin1, count(*) FILTER (score >= 0.5 AND score < 0.75) AS bin2, count(*) FILTER (score >= 0.75) AS bin3, CAST(grid_row // 40 * 10000 + grid_col // 40 AS BIGINT) AS parent FROM cells GROUP BY ALL")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means and bin counts with the map to parent blocks."""
    return rounded(L.block_histogram(X.cells(spark, sf_dir), "grid_row", "grid_col", "score", 10, 4, 4))


@query(f"WITH {X.CELLS_SQL}, q AS (SELECT s_suppkey AS pointer, s_suppkey * 53 % 300 + 800 AS r, s_suppkey * 71 % 400 + 1900 AS c FROM supplier), t AS (SELECT pointer, cell_id, row_number() OVER (PARTITION BY pointer ORDER BY (grid_row - r) ** 2 + (grid_col - c) ** 2, cell_id) AS n FROM q LEFT JOIN cells ON abs(grid_row - r) <= 3 AND abs(grid_col - c) <= 3) SELECT pointer, cell_id FROM t WHERE n = 1")
def cell_at_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target nearest to a pointer within three pixels (Q4)."""
    s = X.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pointer"), (F.col("s_suppkey") * 53 % 300 + 800).alias("r"), (F.col("s_suppkey") * 71 % 400 + 1900).alias("c"))
    steps = F.sequence(F.lit(-3), F.lit(3))
    around = s.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("pointer", (F.col("r") + F.col("i")).alias("grid_row"), (F.col("c") + F.col("j")).alias("grid_col"), (F.col("i") * F.col("i") + F.col("j") * F.col("j")).alias("d"))
    met = around.join(X.cells(spark, sf_dir).select("grid_row", "grid_col", "cell_id"), ["grid_row", "grid_col"])
    best = met.groupBy("pointer").agg(F.min(F.struct("d", "cell_id"))["cell_id"].alias("cell_id"))
    return s.select("pointer").join(best, "pointer", "left")


# A rhombus for each nation.
_RHOMBUS = "corners AS (SELECT n_name AS polygon, k, n_nationkey % 5 * 60 - 140 + (CASE k % 4 WHEN 0 THEN 24.3::DOUBLE WHEN 2 THEN -24.3::DOUBLE ELSE 0 END) AS x, n_nationkey // 5 * 22 - 44 + (CASE k % 4 WHEN 1 THEN 10.3::DOUBLE WHEN 3 THEN -10.3::DOUBLE ELSE 0 END) AS y FROM nation, range(0, 5) t(k))"
_POLYGONS = f"""
WITH {X.PLACES_SQL}, {_RHOMBUS}, edges AS (SELECT a.polygon, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corners a JOIN corners b ON a.polygon = b.polygon AND b.k = a.k + 1),
p AS (SELECT place_id, lon AS x, lat AS y FROM places), n AS (SELECT place_id, polygon, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) AS c FROM p, edges GROUP BY 1, 2),
h AS (SELECT place_id, min(polygon) AS holds FROM n WHERE c % 2 = 1 GROUP BY 1), d AS (SELECT place_id, arg_min(polygon, (round((x - x0) ** 2 + (y - y0) ** 2, 9), polygon)) AS near FROM p, edges WHERE round((x - x0) ** 2 + (y - y0) ** 2, 9) <= 1 GROUP BY 1)
SELECT place_id, coalesce(holds, near) AS polygon, holds IS NOT NULL AS inside FROM p LEFT JOIN h USING (place_id) LEFT JOIN d USING (place_id)"""


@query(_POLYGONS)
def polygon_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon that holds a place, else the nearest within a degree."""
    k, n = F.col("k"), F.col("n_nationkey")
    turn = lambda at, v: F.when(at % 4 == v, 1).when(at % 4 == v + 2, -1).otherwise(0)
    x = lambda at: n % 5 * 60 - 140 + turn(at, 0) * 24.3
    y = lambda at: F.floor(n / 5) * 22 - 44 + turn(at, 1) * 10.3
    corners = X.read(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    edges = corners.select(F.col("n_name").alias("polygon"), x(k).alias("x0"), y(k).alias("y0"), x(k + 1).alias("x1"), y(k + 1).alias("y1"))
    points = X.places(spark, sf_dir).select("place_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return L.polygons_of_points(points, edges, "place_id")
