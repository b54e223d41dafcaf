"""Queries over spatial joins and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as S
from . import fixtures as X
from .scalars import EARTH, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def km(a: str, b: str) -> str:
    return f"(2 * {EARTH}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


# Suppliers as reference points.
SITES = {"site_id": "s_suppkey", "lat": "(s_suppkey * 53 % 1100) / CAST(10 AS DOUBLE) - 55", "lon": "(s_suppkey * 733 % 3600) / CAST(10 AS DOUBLE) - 180", "kind": "CAST(s_suppkey % 3 AS INT)", "complete": "s_suppkey % 4 > 0"}
SITES_SQL = X._select(SITES, "supplier")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.derived(X.read(spark, sf_dir, "supplier"), SITES)


@query(f"WITH {X.PLACES_SQL}, sites AS ({SITES_SQL}) SELECT place_id, site_id, round({km('p', 's')}, 4) AS km FROM places p JOIN sites s ON {km('p', 's')} <= 500")
def haversine_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a radius, by bands and buckets."""
    out = S.within_radius(X.places(spark, sf_dir), sites(spark, sf_dir), 500.0)
    return rounded(out.select("place_id", F.col("r_site_id").alias("site_id"), "km"), 4)


@query(f"WITH {X.PLACES_SQL}, sites AS ({SITES_SQL}) SELECT place_id FROM places p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE {km('p', 's')} <= CASE kind WHEN 0 THEN 900 WHEN 1 THEN 400 ELSE 100 END)")
def near_reference_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places not within the radius of a reference point of its kind."""
    p, s = X.places(spark, sf_dir), sites(spark, sf_dir)
    near = None
    for kind, radius in ((0, 900.0), (1, 400.0), (2, 100.0)):
        hit = S.within_radius(p, s.where(F.col("kind") == kind), radius).select("place_id")
        near = hit if near is None else near.unionByName(hit)
    return p.join(near.distinct(), "place_id", "left_anti").select("place_id")


@query(f"WITH {X.PLACES_SQL}, sites AS ({SITES_SQL}), r AS (SELECT place_id, site_id, {km('p', 's')} AS km FROM places p, sites s WHERE complete) SELECT place_id, near, round(d, 4) AS km FROM (SELECT place_id, arg_min(site_id, (km, site_id)) AS near, min(km) AS d FROM r WHERE km <= 2000 GROUP BY 1)")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest complete site within a radius."""
    return rounded(S.nearest(X.places(spark, sf_dir), sites(spark, sf_dir).where("complete"), "place_id", "site_id", 2000.0), 4)


@query(f"WITH {X.PLACES_SQL}, sites AS ({SITES_SQL}), r AS (SELECT place_id, site_id, kind, {km('p', 's')} AS km, row_number() OVER (PARTITION BY place_id ORDER BY {km('p', 's')}, site_id) AS k FROM places p JOIN sites s ON {km('p', 's')} <= 3000) SELECT place_id, round(sum((kind + 1) / pow(greatest(km, 0.000001::DOUBLE), 2)) / sum(1 / pow(greatest(km, 0.000001::DOUBLE), 2)), 6) AS mean, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1")
def inverse_distance_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the five nearest sites by inverse square distance."""
    s = sites(spark, sf_dir).withColumn("v", F.col("kind") + 1.0)
    return rounded(S.inverse_distance(X.places(spark, sf_dir), s, "place_id", "site_id", "v", 3000.0))


@query(f"WITH {X.PLACES_SQL}, sites AS ({SITES_SQL}), r AS (SELECT place_id, exp(-0.5::DOUBLE * pow({km('p', 's')} / 600, 2)) AS w, kind / 2::DOUBLE AS land, site_id / 10::DOUBLE AS v FROM places p JOIN sites s ON {km('p', 's')} <= 1200) SELECT place_id, round(CASE WHEN sum(w * land) / sum(w) > 0.05::DOUBLE THEN sum(w * land * v) / sum(w * land) ELSE sum(w * v) / sum(w) END, 6) AS mean FROM r GROUP BY 1")
def kernel_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-weighted Gaussian means, unweighted where land is scarce."""
    s = sites(spark, sf_dir).select("lat", "lon", (F.col("kind") / 2).alias("land"), (F.col("site_id") / 10).alias("v"))
    return rounded(S.kernel_mean(X.places(spark, sf_dir), s, "place_id", "v", "land", 600.0))


_GRID = f"{X.CELLS_SQL}, g AS (SELECT cell_id, grid_row, grid_col, score, now, later, km2, species FROM cells)"


@query(f"WITH {_GRID} SELECT CAST(grid_row // 15 AS INT) AS block_row, CAST(grid_col // 15 AS INT) AS block_col, round(avg(CASE WHEN now THEN score END), 6) AS mean, round(count(CASE WHEN now THEN score END) / 225::DOUBLE, 6) AS land FROM g GROUP BY 1, 2")
def block_mean_landfrac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means of what is there and its share (A10, H2; of S8 the block mean)."""
    c = X.cells(spark, sf_dir).withColumn("v", F.when(F.col("now"), F.col("score")))
    return rounded(S.block_mean(c, "v", 15))


@query(f"WITH {_GRID}, p AS (SELECT cell_id, grid_row + CAST(cell_id % 3 AS INT) AS r, grid_col AS c FROM g), v AS (SELECT DISTINCT grid_row, grid_col FROM g WHERE now), h AS (SELECT cell_id, grid_row, grid_col, (grid_row - r) * (grid_row - r) + (grid_col - c) * (grid_col - c) AS d2 FROM p JOIN v ON abs(grid_row - r) <= 3 AND abs(grid_col - c) <= 3), b AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, grid_row, grid_col) AS k FROM h) SELECT cell_id, grid_row, grid_col, CAST(d2 AS INT) AS d2 FROM b WHERE k = 1")
def nearest_valid_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest valid cell within three rings."""
    c = X.cells(spark, sf_dir)
    p = c.select("cell_id", (F.col("grid_row") + F.col("cell_id") % 3).cast("int").alias("grid_row"), "grid_col")
    return S.snap_to_valid(p, c.where("now"), "cell_id").select("cell_id", "grid_row", F.col("grid_col").cast("int").alias("grid_col"), "d2")


@query(f"WITH {_GRID}, p AS (SELECT cell_id, grid_row AS r, grid_col AS c FROM g), v AS (SELECT grid_row, grid_col, score FROM g WHERE later) SELECT cell_id, round(coalesce(avg(score) FILTER (abs(grid_row - r) <= 0 AND abs(grid_col - c) <= 0), avg(score) FILTER (abs(grid_row - r) <= 1 AND abs(grid_col - c) <= 1), avg(score)), 6) AS mean FROM p LEFT JOIN v ON abs(grid_row - r) <= 2 AND abs(grid_col - c) <= 2 GROUP BY 1")
def widening_radius_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the smallest square that has any valid cell."""
    c = X.cells(spark, sf_dir)
    return rounded(S.widening_mean(c, c.where("later"), "cell_id", "score"))


_BILINEAR = f"""
WITH {X.PLACES_SQL}, grid AS (SELECT i AS gi, j AS gj, CASE WHEN (i * 31 + j * 17) % 13 > 0 THEN ((i * 7 + j * 3) % 50)::DOUBLE END AS v FROM range(0, 48) a(i), range(0, 144) b(j)),
p AS (SELECT place_id, (lat + 60) / 2.5::DOUBLE AS y, (lon + 180) / 2.5::DOUBLE AS x FROM places), q AS (SELECT place_id, floor(y) AS i, floor(x) AS j, y - floor(y) AS v, x - floor(x) AS u FROM p),
c AS (SELECT place_id, i + a AS gi, (j + b) % 144 AS gj, (CASE WHEN a = 1 THEN q.v ELSE 1 - q.v END) * (CASE WHEN b = 1 THEN u ELSE 1 - u END) AS w FROM q, range(0, 2) t(a), range(0, 2) s(b))
SELECT place_id, round(sum(v * w) / sum(w), 6) AS value FROM c JOIN grid ON c.gi = grid.gi AND c.gj = grid.gj WHERE v IS NOT NULL GROUP BY 1 HAVING sum(w) > 0"""


@query(_BILINEAR)
def bilinear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-corner interpolation that wraps and skips missing corners."""
    i, j = F.col("gi"), F.col("gj")
    grid = spark.range(48 * 144).select(F.floor(F.col("id") / 144).alias("gi"), (F.col("id") % 144).alias("gj"))
    grid = grid.withColumn("v", F.when((i * 31 + j * 17) % 13 > 0, ((i * 7 + j * 3) % 50).cast("double")))
    out = S.bilinear(X.places(spark, sf_dir), grid, "place_id", "v", -60.0, -180.0, 2.5, 144)
    return rounded(out.where("value is not null"))


@query(f"WITH {_GRID}, m AS (SELECT DISTINCT grid_row, grid_col FROM g WHERE now) SELECT DISTINCT CAST(grid_row + a AS INT) AS grid_row, CAST(grid_col + b AS INT) AS grid_col FROM m, range(-2, 3) t(a), range(-2, 3) s(b)")
def dilate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within two steps of a mask."""
    return S.dilate(X.cells(spark, sf_dir).where("now"), 2).select(F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col"))


@query(f"WITH {_GRID}, m AS (SELECT DISTINCT grid_row // 24 AS grid_row, grid_col // 24 AS grid_col FROM g) SELECT CAST(a.grid_row AS INT) AS grid_row, CAST(a.grid_col AS INT) AS grid_col FROM m a JOIN m b ON abs(a.grid_row - b.grid_row) + abs(a.grid_col - b.grid_col) = 1 GROUP BY 1, 2 HAVING count(*) = 4")
def erode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose four neighbours are in the mask."""
    coarse = X.cells(spark, sf_dir).select(F.floor(F.col("grid_row") / 24).cast("int").alias("grid_row"), F.floor(F.col("grid_col") / 24).cast("int").alias("grid_col"))
    return S.erode(coarse).select("grid_row", "grid_col")


@query(f"WITH {_GRID}, m AS (SELECT DISTINCT grid_row // 6 AS r, grid_col // 6 AS c FROM g WHERE now), e AS (SELECT r, c, 'right' AS side FROM m UNION ALL SELECT r, c - 1, 'right' FROM m UNION ALL SELECT r, c, 'below' FROM m UNION ALL SELECT r - 1, c, 'below' FROM m) SELECT CAST(r AS INT) AS grid_row, CAST(c AS INT) AS grid_col, side FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1")
def region_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges where a region begins or ends (Q6)."""
    m = X.cells(spark, sf_dir).where("now").select(F.floor(F.col("grid_row") / 6).cast("int").alias("grid_row"), F.floor(F.col("grid_col") / 6).cast("int").alias("grid_col"))
    return S.outline(m).select(F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col"), "side")


@query(f"WITH {_GRID}, q AS (SELECT grid_row, grid_col, CAST(floor(score * 127) AS INT) AS s, CAST(cell_id % 256 AS INT) AS a, CAST(cell_id % 2 AS INT) AS n FROM g), l AS (SELECT unnest([1, 2, 4, 8]) AS f) SELECT f, CAST(grid_row // f AS INT) AS r, CAST(grid_col // f AS INT) AS c, max(s) AS s, CAST((max(a >> 4) << 4) | max(a & 15) AS INT) AS a, bit_or(n) AS n FROM q, l GROUP BY 1, 2, 3")
def pyramid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled levels: largest suitability, largest nibbles, any flag."""
    c = X.cells(spark, sf_dir)
    q = c.select("grid_row", "grid_col", F.floor(F.col("score") * 127).cast("int").alias("s"), (F.col("cell_id") % 256).cast("int").alias("a"), (F.col("cell_id") % 2).cast("int").alias("n"), F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("f"))
    high, low = F.max(F.shiftright("a", 4)), F.max(F.col("a").bitwiseAND(F.lit(15)))
    return q.groupBy("f", F.floor(F.col("grid_row") / F.col("f")).cast("int").alias("r"), F.floor(F.col("grid_col") / F.col("f")).cast("int").alias("c")).agg(F.max("s").alias("s"), F.shiftleft(high, 4).bitwiseOR(low).alias("a"), F.bit_or("n").alias("n"))


_MORTON = " | ".join(f"((((x >> {k}) & 1) << {2 * k}) | (((y >> {k}) & 1) << {2 * k + 1}))" for k in range(12))


@query(f"WITH {X.PLACES_SQL}, p AS (SELECT place_id, country, CAST(floor((lon + 180) * 10) AS BIGINT) AS x, CAST(floor((lat + 90) * 10) AS BIGINT) AS y FROM places), z AS (SELECT place_id, country, {_MORTON} AS z FROM p) SELECT place_id, country, z, CAST(ntile(4) OVER (PARTITION BY country ORDER BY z, place_id) AS INT) AS shard FROM z")
def morton_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a region along the Morton curve."""
    from pyspark.sql import Window

    x, y = F.floor((F.col("lon") + 180) * 10), F.floor((F.col("lat") + 90) * 10)
    p = X.places(spark, sf_dir).select("place_id", "country", G.morton(x, y, 12).alias("z"))
    return p.withColumn("shard", F.ntile(4).over(Window.partitionBy("country").orderBy("z", "place_id")))


_CITY = f"""
WITH {_GRID}, c AS (SELECT cell_id AS city, grid_row + 1 AS r, grid_col - 1 AS k FROM g),
h AS (SELECT city, coalesce(bool_or(now), false) AS a, coalesce(bool_or(later), false) AS b FROM c LEFT JOIN g ON abs(grid_row - r) <= 1 AND abs(grid_col - k) <= 1 GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'keep' WHEN a THEN 'lose' WHEN b THEN 'gain' ELSE 'none' END AS code, count(*) AS n FROM h GROUP BY 1"""


@query(_CITY)
def city_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the neighbourhood of a city loses, keeps and gains."""
    g = X.cells(spark, sf_dir)
    c = g.select(F.col("cell_id").alias("city"), (F.col("grid_row") + 1).alias("_r"), (F.col("grid_col") - 1).alias("_c"), F.explode(S.neighbours(1)).alias("o"))
    c = c.select("city", (F.col("_r") + F.col("o.di")).alias("grid_row"), (F.col("_c") + F.col("o.dj")).alias("grid_col"))
    seen = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    h = c.join(g.select("grid_row", "grid_col", "now", "later"), ["grid_row", "grid_col"], "left").groupBy("city").agg(seen("now").alias("a"), seen("later").alias("b"))
    code = F.when(F.col("a") & F.col("b"), "keep").when(F.col("a"), "lose").when(F.col("b"), "gain").otherwise("none")
    return h.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH {_GRID} SELECT species, round(greatest(quantile_cont(90 - (grid_row + 0.5::DOUBLE) / 24, 0.01) - 3, -90), 6) AS south, round(least(quantile_cont(90 - (grid_row + 0.5::DOUBLE) / 24, 0.99) + 3, 90), 6) AS north, round(quantile_cont(-180 + (grid_col + 0.5::DOUBLE) / 24, 0.01) - 3, 6) AS west, round(quantile_cont(-180 + (grid_col + 0.5::DOUBLE) / 24, 0.99) + 3, 6) AS east FROM g WHERE score >= 0.5::DOUBLE GROUP BY 1")
def suitable_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the middle 98 per cent of suitable cells, padded."""
    c = X.cells(spark, sf_dir).where("score >= 0.5")
    q = lambda col, p: F.percentile(col, F.lit(p))
    return rounded(c.groupBy("species").agg(F.greatest(q("lat", 0.01) - 3, F.lit(-90.0)).alias("south"), F.least(q("lat", 0.99) + 3, F.lit(90.0)).alias("north"), (q("lon", 0.01) - 3).alias("west"), (q("lon", 0.99) + 3).alias("east")))


_FILL = f"""
WITH {_GRID}, px AS (SELECT min(cell_id) AS cell_id, grid_row, grid_col, avg(score) FILTER (later) - avg(score) FILTER (now) AS change FROM g GROUP BY 2, 3),
h AS (SELECT a.cell_id, b.change, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.grid_row - b.grid_row) ** 2 + (a.grid_col - b.grid_col) ** 2, b.grid_row, b.grid_col) AS k FROM px a JOIN px b ON abs(a.grid_row - b.grid_row) <= 3 AND abs(a.grid_col - b.grid_col) <= 3 WHERE a.change IS NULL AND b.change IS NOT NULL)
SELECT px.cell_id, round(coalesce(px.change, h.change), 6) AS change, px.change IS NULL AND h.change IS NOT NULL AS filled FROM px LEFT JOIN h ON px.cell_id = h.cell_id AND k = 1"""


@query(_FILL)
def change_with_ocean_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two periods, ocean cells filled from their nearest land cell."""
    mean = lambda when: F.avg(F.when(F.col(when), F.col("score")))
    px = X.cells(spark, sf_dir).groupBy("grid_row", "grid_col").agg(F.min("cell_id").alias("cell_id"), (mean("later") - mean("now")).alias("change"))
    return rounded(S.filled_change(px, "cell_id", "change"))
