"""Queries over evidence, choices, places and the rest of the inventory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import config
from ..functions import climate as C
from ..functions import geo as G
from ..functions import numeric
from ..operators import evidence as E
from ..operators import models as D
from ..operators import ranges as R
from ..operators import spatial as S
from ..operators import survey
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


@query(f"WITH {X.PLACES_SQL}, p AS (SELECT place_id, CASE country % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'KE' WHEN 2 THEN 'XX' WHEN 3 THEN 'DE' ELSE 'MX' END AS c, lat, lon, place_id % 2 AS d FROM places), r AS (SELECT *, CASE WHEN c = 'US' AND lat < 23 THEN 'Oceania' WHEN c IN ('US', 'MX') THEN 'North America' WHEN c = 'KE' THEN 'Africa' WHEN c = 'DE' THEN 'Europe' ELSE 'Other' END AS region FROM p) SELECT place_id, region, CASE WHEN d = 0 THEN CASE WHEN c IN ('US', 'CA', 'MX') THEN lower(c) ELSE 'na' END ELSE replace(lower(region), ' ', '-') END AS download, printf('%.4f,%.4f', CASE WHEN round(lat / 7, 4) = 0 THEN 0.0::DOUBLE ELSE round(lat / 7, 4) END, CASE WHEN round(lon / 7, 4) = 0 THEN 0.0::DOUBLE ELSE round(lon / 7, 4) END) AS key FROM r")
def place_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, download groups and keys of places."""
    code = F.element_at(F.array(*map(F.lit, ("US", "KE", "XX", "DE", "MX"))), (F.col("country") % 5 + 1).cast("int"))
    p = X.places(spark, sf_dir).withColumn("country", code)
    regions = spark.createDataFrame([("US", "North America"), ("MX", "North America"), ("KE", "Africa"), ("DE", "Europe")], "country string, region string")
    r = E.region_of(p, regions)
    return r.select("place_id", "region", E.download_group(F.col("place_id") % 2, F.col("country"), F.col("region")).alias("download"), E.place_key(F.col("lat") / 7, F.col("lon") / 7).alias("key"))


@query("WITH g AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'tree' WHEN 1 THEN 'bird' WHEN 2 THEN 'fish' WHEN 3 THEN 'crop' ELSE 'fungus' END AS g FROM part) SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 33::DOUBLE ELSE CASE g WHEN 'tree' THEN 15 WHEN 'bird' THEN 100 WHEN 'fish' THEN 50 WHEN 'crop' THEN 10 ELSE 20 END::DOUBLE END AS km FROM g")
def dispersal_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersal rates by group, a species' own first."""
    k = F.col("p_partkey")
    g = F.element_at(F.array(*map(F.lit, ("tree", "bird", "fish", "crop", "fungus"))), (k % 5 + 1).cast("int"))
    c = config()
    return X.read(spark, sf_dir, "part").select("p_partkey", E.dispersal(g, c["dispersal_km"], c["dispersal_default"], F.when(k % 7 == 0, F.lit(33.0))).alias("km"))


@query("WITH f AS (SELECT c_custkey AS k, list_filter([CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END, CASE WHEN c_custkey % 12 = 11 THEN NULL ELSE c_custkey % 2 END], lambda x: x IS NOT NULL) AS f FROM customer), r AS (SELECT k, list_reverse_sort(f) AS f FROM f) SELECT k, (['ok', 'moderate', 'high'])[f[1] + 1] AS worst, (['ok', 'moderate', 'high'])[CASE WHEN len(f) >= 2 THEN f[2] ELSE f[1] END + 1] AS corroborated FROM r")
def combined_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of several sources by the worst and the corroborated rule."""
    k = F.col("c_custkey")
    flags = F.array(F.when(k % 4 == 0, "ok").when(k % 4 == 1, "moderate").when(k % 4 == 2, "high"), F.when(k % 3 == 0, "moderate").when(k % 3 == 1, "high"), F.when(k % 12 != 11, F.when(k % 2 == 0, "ok").otherwise("moderate")))
    return X.read(spark, sf_dir, "customer").select(k.alias("k"), E.combined_flag(flags, False).alias("worst"), E.combined_flag(flags, True).alias("corroborated"))


@query("WITH s AS (SELECT p_partkey AS k, p_partkey % 60 / 100::DOUBLE AS a, p_partkey % 30 / 100::DOUBLE AS b FROM part) SELECT k, round(b + CASE WHEN k % 2 = 0 THEN a ELSE 0 END, 6) AS outside, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM s JOIN part ON k = p_partkey")
def outside_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares outside a list, and slugs (H21, string family)."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("ASIA:"), (k % 60 / 100).cast("string"), F.lit(";EUROPE:"), (k % 30 / 100).cast("string"), F.lit(";junk"))
    inside = F.when(k % 2 == 0, F.array(F.lit("AFRICA"))).otherwise(F.array(F.lit("ASIA")))
    return rounded(X.read(spark, sf_dir, "part").select(k.alias("k"), E.outside_share(text, inside).alias("outside"), E.slug(F.col("p_name")).alias("slug")))


_FOOT = "SELECT c_custkey AS k, CAST(i - 1 AS INT) AS i, round(CASE WHEN i > 8 AND i <= 12 THEN (c_custkey % 90 + i + 1) * (c_custkey % 50 + 2 * i + 1) / (c_custkey % 70 + i + 1)::DOUBLE - 1 ELSE c_custkey % 90 + i + c_custkey % 50 + 2 * i - c_custkey % 70 - i END, 5) AS v FROM customer, range(1, 17) t(i)"


@query(_FOOT)
def matched_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines moved from a point to a box."""
    k = F.col("c_custkey")
    vec = lambda m, s: F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (k % m + s * i).cast("double"))
    c = X.read(spark, sf_dir, "customer").select(k.alias("k"), vec(90, 1).alias("base"), vec(70, 1).alias("point"), vec(50, 2).alias("box"))
    return rounded(c.select("k", F.posexplode(E.matched_footprint(F.col("base"), F.col("point"), F.col("box"))).alias("i", "v")), 5)


_RUNS = "runs AS (SELECT p_partkey // 3 AS organism, p_partkey // 3 % 2 = 0 AS is_bird, (['breeding', 'rg_all', 'all'])[p_partkey % 3 + 1] AS kind, (['A', 'B', 'B', 'C', 'B', 'C', 'B'])[p_partkey % 7 + 1] AS tier, p_size % 4 > 0 AS publishable FROM part)"


@query(f"WITH {_RUNS} SELECT organism, kind, tier FROM (SELECT *, row_number() OVER (PARTITION BY organism ORDER BY CASE WHEN tier = 'A' THEN 0 ELSE 1 END, CASE WHEN is_bird THEN CASE kind WHEN 'breeding' THEN 0 WHEN 'rg_all' THEN 1 ELSE 2 END ELSE CASE kind WHEN 'rg_all' THEN 0 WHEN 'all' THEN 1 ELSE 2 END END) AS k FROM runs WHERE publishable AND tier IN ('A', 'B')) WHERE k = 1")
def preferred_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each organism that is published."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    organism = F.floor(k / 3)
    runs = X.read(spark, sf_dir, "part").select(organism.alias("organism"), (organism % 2 == 0).alias("is_bird"), pick(("breeding", "rg_all", "all"), 3).alias("kind"), pick("ABBCBCB", 7).alias("tier"), (F.col("p_size") % 4 > 0).alias("publishable"))
    return E.preferred_run(runs).select("organism", "kind", "tier")


def species_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = lambda a, n: (k * a % n) / n
    return X.read(spark, sf_dir, "part").select(
        (k % 12).alias("survey"), k.alias("species"), (k % 5 > 0).alias("eligible"), F.when(k % 9 > 0, k * 7 % 10 < 4 + k % 12).alias("direction_agree"), F.when(k % 8 > 0, unit(11, 97) + 0.3 + (k % 12) * 0.1).alias("ratio"),
        F.when(k % 6 > 0, unit(13, 89)).alias("correlation"), (unit(17, 83) * 100).alias("error"), F.when(k % 10 > 0, unit(19, 79) * 100 + (k % 12) * 4).alias("error_null"), (k * 3 % 10 < 6).alias("area_sign"), (k * 9 % 10 < 3 + k % 12).alias("beats_null"),
        F.when(k % 11 > 0, k % 4 > 0).alias("cv_gate"), F.when(k % 13 > 0, k % 3 > 0).alias("transfer_ok"), unit(23, 73).alias("boyce2"),
    )


@query()
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of surveys over their species."""
    return E.group_verdict(species_results(spark, sf_dir), ["survey"], 40)


@query()
def species_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of species under their survey's verdict."""
    s = species_results(spark, sf_dir)
    v = E.group_verdict(s, ["survey"], 40).select("survey", "status")
    return E.species_verdict(s.join(v, "survey")).select("species", "tier", F.array_join("reasons", ";").alias("reasons"))


_ROUTE = f"""
WITH {X.CELLS_SQL}, routes AS (SELECT cell_id AS route, CAST(grid_row // 20 AS INT) AS grid_row, CAST(grid_col // 20 AS INT) AS grid_col, lat, lon FROM cells), presence AS (SELECT cell_id AS route, now AS p1, later AS p2 FROM cells WHERE now OR later),
scores AS (SELECT CAST(grid_row // 20 AS INT) AS grid_row, CAST(grid_col // 20 AS INT) AS grid_col, avg(score) AS score1, max(score) AS score2 FROM cells WHERE score > 0.3::DOUBLE GROUP BY 1, 2)
SELECT grid_row, grid_col, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, bool_or(coalesce(p1, false)) AS p1, bool_or(coalesce(p2, false)) AS p2, count(DISTINCT route) AS routes, round(avg(score1), 6) AS score1, round(avg(score2), 6) AS score2 FROM routes LEFT JOIN presence USING (route) JOIN scores USING (grid_row, grid_col) GROUP BY 1, 2"""


@query(_ROUTE)
def route_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes to cells with presence and mean scores."""
    c = X.cells(spark, sf_dir)
    coarse = [F.floor(F.col(n) / 20).cast("int").alias(n) for n in ("grid_row", "grid_col")]
    routes = c.select(F.col("cell_id").alias("route"), *coarse, "lat", "lon")
    presence = c.where("now or later").select(F.col("cell_id").alias("route"), F.col("now").alias("p1"), F.col("later").alias("p2"))
    scores = c.where("score > 0.3").groupBy(*coarse).agg(F.avg("score").alias("score1"), F.max("score").alias("score2"))
    return rounded(survey.route_cells(routes, presence, scores))


@query(f"WITH {X.CELLS_SQL}, units AS (SELECT DISTINCT CAST(grid_row // 40 AS INT) AS r, CAST(grid_col // 40 AS INT) AS c, 'unit' || ((grid_row // 40 * 7 + grid_col // 40) % 9) AS unit FROM cells), allowed AS (SELECT DISTINCT species, 'unit' || (length(species) + p) AS unit FROM cells, range(0, 4) t(p)), native AS (SELECT cell_id, unit, EXISTS (SELECT 1 FROM allowed a WHERE a.species = cells.species AND a.unit = units.unit) AS native FROM cells JOIN units ON grid_row // 40 = r AND grid_col // 40 = c) SELECT cell_id, unit, native, unit IN ('unit1', 'unit2') AND NOT native AS introduced FROM native")
def native_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the unit that holds them, native or introduced."""
    c = X.cells(spark, sf_dir).withColumn("r", F.floor(F.col("grid_row") / 40).cast("int")).withColumn("c", F.floor(F.col("grid_col") / 40).cast("int"))
    units = c.select("r", "c").distinct().withColumn("unit", F.concat(F.lit("unit"), ((F.col("r") * 7 + F.col("c")) % 9).cast("string")))
    allowed = c.select("species").distinct().select("species", F.explode(F.array(*map(F.lit, range(4)))).alias("p")).select("species", F.concat(F.lit("unit"), (F.length("species") + F.col("p")).cast("string")).alias("unit"), F.lit(True).alias("ok"))
    out = c.join(units, ["r", "c"]).join(allowed, ["species", "unit"], "left").withColumn("native", F.coalesce("ok", F.lit(False)))
    return out.select("cell_id", "unit", "native", (F.col("unit").isin("unit1", "unit2") & ~F.col("native")).alias("introduced"))


@query("SELECT doc_id, lang, regexp_matches(lower(source), 'src1') AND NOT regexp_matches(coalesce(text, ''), '(?i)\\b(nc|nd)\\b|non-?commercial|no ?deriv|fair use|all rights') AS reusable FROM documents")
def reusable_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A licence test with exclusions."""
    refused = F.coalesce("text", F.lit("")).rlike(r"(?i)\b(nc|nd)\b|non-?commercial|no ?deriv|fair use|all rights")
    return X.read(spark, sf_dir, "documents").select("doc_id", "lang", (F.lower("source").rlike("src1") & ~refused).alias("reusable"))


_RARE = "WITH c AS (SELECT l_partkey AS k, l_suppkey % 7 AS cont, l_quantity AS lat, l_extendedprice / 1000 AS lon FROM lineitem), n AS (SELECT k, cont, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT k, cont, n / sum(n) OVER (PARTITION BY k) AS share, row_number() OVER (PARTITION BY k ORDER BY n DESC, cont) AS r FROM n), q AS (SELECT k, list_sort(list(lat)) AS v, count(DISTINCT (floor(lat * 2), floor(lon * 2))) AS cells FROM c GROUP BY 1) SELECT k, cont AS continent, round(share, 6) AS share, round(v[least(len(v), CAST(floor(0.05::DOUBLE * len(v)) AS INT) + 1)], 6) AS p5, round(v[least(len(v), CAST(floor(0.95::DOUBLE * len(v)) AS INT) + 1)], 6) AS p95, cells FROM t JOIN q USING (k) WHERE r = 1"


@query(_RARE)
def dominant_continent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant continent and its share, lower-index percentiles, half-degree cells."""
    c = X.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 7).alias("cont"), F.col("l_quantity").alias("lat"), (F.col("l_extendedprice") / 1000).alias("lon"))
    n = c.groupBy("k", "cont").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("cont", F.struct("n", -F.col("cont"))).alias("continent"), (F.max("n") / F.sum("n")).alias("share"))
    w = Window.partitionBy("k").orderBy("lat")
    placed = c.withColumn("at", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(Window.partitionBy("k")))
    value = lambda p: F.max(F.when(F.col("at") == F.least(F.col("all") - 1, F.floor(F.col("all") * p)), F.col("lat")))
    q = placed.groupBy("k").agg(value(0.05).alias("p5"), value(0.95).alias("p95"), F.countDistinct(F.floor(F.col("lat") * 2), F.floor(F.col("lon") * 2)).alias("cells"))
    return rounded(n.join(q, "k"))


@query()
def mahalanobis_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a reference cloud, with a trimmed fit."""
    p = X.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    return rounded(E.mahalanobis_novelty(p, p.where("a > 10"), ["a", "b"], "k", trim=0.95), 4)


@query()
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation of predictors."""
    li = X.read(spark, sf_dir, "lineitem")
    return rounded(spark.createDataFrame(E.variance_inflation(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "predictor string, vif double"), 3)


@query(f"WITH {X.CELLS_SQL}, s AS (SELECT species, count(*) FILTER (now) AS n FROM cells GROUP BY 1) SELECT species, n, round(2 * abs(n * 10) * abs(sin((n % 7) / 14::DOUBLE)), 6) AS error, n >= 20 AS eligible FROM s")
def random_direction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of shifts in a wrong direction, and eligibility."""
    s = X.cells(spark, sf_dir).groupBy("species").agg(F.sum(F.col("now").cast("int")).alias("n"))
    return rounded(s.select("species", "n", E.random_bearing_error(F.col("n") * 10, F.col("n") % 7 / 7).alias("error"), (F.col("n") >= 20).alias("eligible")))


@query()
def seedling_adult_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts from adults to seedlings over blocks with enough plots."""
    c = X.cells(spark, sf_dir).withColumn("cluster", F.floor(F.col("grid_row") / 100) * 1000 + F.floor(F.col("grid_col") / 100))
    blocks = c.groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.lit(1.0).alias("km2"), F.bool_or("now").alias("now"), F.bool_or("later").alias("later"), F.count("*").alias("n")).where("n >= 8").withColumn("test", F.lit("all"))
    return rounded(R.resampled_shift(blocks, "test", n=200))


@query()
def effort_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts on well-sampled cells against all cells."""
    c = X.cells(spark, sf_dir)
    every = R.change_summary(c, ["species"]).select("species", F.col("shift_km").alias("every"))
    good = R.change_summary(c.where("score > 0.3"), ["species"]).select("species", F.col("shift_km").alias("good"))
    return rounded(every.join(good, "species").select("species", "every", "good", (F.col("good") - F.col("every")).alias("gap")), 4)


@query()
def future_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors of a projected climate: water balance by the change of a model's own."""
    c = X.climate(spark, sf_dir, changes=True)
    tx = F.zip_with("tmax", "dtx", lambda a, b: a + b)
    tn = F.zip_with(F.zip_with("tmin", "dtn", lambda a, b: a + b), tx, lambda a, b: F.least(a, b - 0.1))
    p = F.zip_with("ppt", "rp", lambda a, b: a * C.clip(b, 0.2, 5.0))
    c = c.withColumn("ftx", tx).withColumn("ftn", tn).withColumn("fp", p)
    pet = lambda a, b: C.hargreaves_pet(F.col(a), F.col(b), F.col("lat"))
    c = c.select("place_id", "tmax", "tmin", "ppt", "ftx", "ftn", "fp", pet("tmax", "tmin").alias("pet"), pet("ftx", "ftn").alias("fpet"), *[x.alias(n) for n, x in C.bioclim(F.col("ftx"), F.col("ftn"), F.col("fp")).items()])

    def run(frames):
        for f in frames:
            a = {n: np.stack(f[n]) for n in ("tmax", "tmin", "ppt", "ftx", "ftn", "fp", "pet", "fpet")}
            room = np.full(len(f), 100.0)
            now = numeric.water_balance(a["ppt"], a["pet"], (a["tmax"] + a["tmin"]) / 2, room)
            later = numeric.water_balance(a["fp"], a["fpet"], (a["ftx"] + a["ftn"]) / 2, room)
            aet, cwd = (np.maximum(n.sum(axis=1) + (x - n).sum(axis=1), 0) for n, x in zip(now, later, strict=True))
            yield pd.DataFrame({"place_id": f.place_id, "bio1": f.bio1, "bio12": f.bio12, "gdd": numeric.growing_degree_days(a["ftx"], a["ftn"]), "aet": aet, "cwd": cwd})

    return rounded(c.mapInPandas(run, "place_id long, bio1 double, bio12 double, gdd double, aet double, cwd double"), 4)


_BAND = f"WITH {X.CLIMATE_SQL}, v AS (SELECT place_id, CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m <= 5 THEN 'MAM' WHEN m <= 8 THEN 'JJA' ELSE 'SON' END AS s, tmax, dtx FROM climate), a AS (SELECT place_id, s, avg(tmax) AS x, avg(tmax + dtx) AS y FROM v GROUP BY 1, 2) SELECT s, CAST(count(*) FILTER (abs(y - x) > 2) AS BIGINT) AS moved, round(median(y - x), 6) AS change FROM a GROUP BY 1"


@query(_BAND)
def extras_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far seasonal values move between two runs."""
    c = X.climate_long(spark, sf_dir, changes=True)
    season = F.when(F.col("m").isin(12, 1, 2), "DJF").when(F.col("m") <= 5, "MAM").when(F.col("m") <= 8, "JJA").otherwise("SON")
    a = c.groupBy("place_id", season.alias("s")).agg(F.avg("tmax").alias("x"), F.avg(F.col("tmax") + F.col("dtx")).alias("y"))
    d = F.col("y") - F.col("x")
    return rounded(a.groupBy("s").agg(F.sum(F.when(F.abs(d) > 2, 1).otherwise(0)).alias("moved"), F.median(d).alias("change")))


_CALIBRATION = f"""
WITH {X.CLIMATE_SQL}, c AS (SELECT place_id, country, min(tmin) AS cold, max(vap) AS v FROM climate GROUP BY 1, 2), o AS (SELECT country, cold, cold * 0.9::DOUBLE - v * 4 + place_id * 31 % 17 / 5::DOUBLE AS seen FROM c)
SELECT country, count(*) AS n, round(greatest(regr_slope(seen, cold), 0), 6) AS slope, round(avg(seen) - greatest(regr_slope(seen, cold), 0) * avg(cold), 6) AS intercept FROM o GROUP BY 1"""


@query(_CALIBRATION)
def estimator_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of observed extremes on the coldest month, a line for each country with no negative slope."""
    c = X.climate(spark, sf_dir)
    cold = F.array_min("tmin")
    o = c.select("country", cold.alias("cold"), (cold * 0.9 - F.array_max("vap") * 4 + F.col("place_id") * 31 % 17 / 5).alias("seen"))
    slope = F.greatest(F.regr_slope("seen", "cold"), F.lit(0.0))
    return rounded(o.groupBy("country").agg(F.count("*").alias("n"), slope.alias("slope"), (F.avg("seen") - slope * F.avg("cold")).alias("intercept")))


@query()
def decimated_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change evaluated on a lattice and carried to every cell by its nearest lattice cell."""
    c = X.cells(spark, sf_dir)
    lattice = c.where("grid_row % 4 = 0 and grid_col % 4 = 0").select("cell_id", "lat", "lon", F.col("score").alias("change"))
    near = S.nearest(c.select("cell_id", "lat", "lon"), lattice.withColumnRenamed("cell_id", "rep"), "cell_id", "rep", 60.0)
    return rounded(c.select("cell_id", "km2").join(near, "cell_id").join(lattice.select(F.col("cell_id").alias("near"), "change"), "near").select("cell_id", "near", (F.col("km2") + F.col("change")).alias("value")))


@query()
def farthest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A farthest-point sample of few places, one pass for each (T5)."""
    x, y, z = G.unit_xyz(F.col("lat"), F.col("lon"))
    p = X.places(spark, sf_dir).select("place_id", x.alias("x"), y.alias("y"), z.alias("z"))
    seed = p.orderBy("place_id").first()
    picked, best = [seed], F.lit(None).cast("double")
    for _ in range(7):
        s = picked[-1]
        best = F.least(best, F.pow(F.col("x") - s.x, F.lit(2.0)) + F.pow(F.col("y") - s.y, F.lit(2.0)) + F.pow(F.col("z") - s.z, F.lit(2.0)))
        picked.append(p.withColumn("d", best).orderBy(F.col("d").desc(), "place_id").first())
    return spark.createDataFrame([(k, r.place_id) for k, r in enumerate(picked)], "pick int, place_id long")


@query("WITH d AS (SELECT DISTINCT doc_id FROM labels), p AS (SELECT doc_id, quality = 1 AS seen FROM labels), s AS (SELECT doc_id, n_chars % 100 / 100::DOUBLE AS s FROM documents), j AS (SELECT seen, s FROM p JOIN s USING (doc_id)) SELECT count(*) FILTER (seen) AS presences, count(*) FILTER (NOT seen) AS absences, count(*) FILTER (seen) >= 20 AND count(*) FILTER (NOT seen) >= 20 AS enough, round(avg(s) FILTER (seen), 6) AS seen_mean FROM j")
def survey_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of a survey check."""
    lab = X.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("seen"))
    j = lab.join(X.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("s")), "doc_id")
    a, b = F.sum(F.when(F.col("seen"), 1).otherwise(0)), F.sum(F.when(F.col("seen"), 0).otherwise(1))
    return rounded(j.agg(a.alias("presences"), b.alias("absences"), ((a >= 20) & (b >= 20)).alias("enough"), F.avg(F.when(F.col("seen"), F.col("s"))).alias("seen_mean")))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def worst_fifteen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen worst rows of a report."""
    return X.read(spark, sf_dir, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(15).select("p_partkey", "p_retailprice")


@query(f"WITH {X.CLIMATE_SQL}, u AS (SELECT p_partkey, 220 + p_size::DOUBLE * 2 AS kelvin, p_retailprice / 1e8::DOUBLE AS rate FROM part) SELECT p_partkey, round(kelvin - 273.15::DOUBLE, 6) AS celsius, round(rate * 86400, 6) AS mm FROM u")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelvin to degrees, and kg a square metre and second to mm a day."""
    p = X.read(spark, sf_dir, "part").select("p_partkey", (220 + F.col("p_size") * 2.0).alias("kelvin"), (F.col("p_retailprice") / 1e8).alias("rate"))
    return rounded(p.select("p_partkey", C.celsius(F.col("kelvin")).alias("celsius"), C.mm_a_day(F.col("rate")).alias("mm")))


@query()
def virtual_species_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A virtual species fitted and compared with its truth in blocks that the fit has not seen (of D17 the evaluation)."""
    from .skill import presence_background

    p = D.block_folds(presence_background(spark, sf_dir), "x", "y", 200.0, F.col("present") == 1, folds=2)
    train = D.training_sample(p, "present", "cell", config()["fit"]["max_presences"])
    scored = D.cross_validated(p, "glm", ["a", "b"], "present", "fold", train=train)
    truth = scored.withColumn("truth", F.col("niche") >= 0.5).withColumn("predicted", F.col("raw") >= 0.6).withColumn("km2", F.lit(1.0)).withColumn("all", F.lit("one"))
    return rounded(R.agreement(truth, ["all"], "predicted", "truth"), 2)


@query(f"WITH {X.CELLS_SQL}, b AS (SELECT cell_id, CAST(grid_row // 6 AS INT) AS r, CAST(grid_col // 6 AS INT) AS c, grid_row, grid_col, score FROM cells), boxes AS (SELECT DISTINCT r, c FROM b), px AS (SELECT r, c, r * 6 + i AS pr, c * 6 + j AS pc FROM boxes, range(0, 6) t(i), range(0, 6) s(j)) SELECT px.r, px.c, round(avg(score), 6) AS mean, count(score) AS n FROM px LEFT JOIN b ON pr = grid_row AND pc = grid_col GROUP BY 1, 2")
def box_pixel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the 6 by 6 pixels of coarse cells."""
    c = X.cells(spark, sf_dir)
    coarse = [F.floor(F.col(n) / 6).cast("int").alias(n) for n in ("grid_row", "grid_col")]
    boxes = S.box_pixels(c.select(*coarse).distinct(), 6)
    fine = c.select(F.col("grid_row").alias("pixel_row"), F.col("grid_col").alias("pixel_col"), "score")
    met = boxes.join(fine, ["pixel_row", "pixel_col"], "left")
    return rounded(met.groupBy(F.col("grid_row").alias("r"), F.col("grid_col").alias("c")).agg(F.avg("score").alias("mean"), F.count("score").alias("n")))


@query("WITH w AS (SELECT CAST(y AS INT) AS start FROM (VALUES (1970), (2000)) t(y)), v AS (SELECT unnest(['tmax', 'tmin', 'ppt', 'vap']) AS variable), j AS (SELECT variable, start, CAST(start + k AS INT) AS year FROM v, w, range(0, 30) r(k)) SELECT variable, start, year, CAST((year - start) // 5 AS INT) AS part FROM j")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-years of two windows, dealt to parts: a plan's fixed grid."""
    j = spark.range(1).select(F.explode(F.array(*map(F.lit, ("tmax", "tmin", "ppt", "vap")))).alias("variable")).withColumn("start", F.explode(F.array(F.lit(1970), F.lit(2000)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return j.select("variable", "start", (F.col("start") + F.col("k")).alias("year"), F.floor(F.col("k") / 5).cast("int").alias("part"))


@query("SELECT c_custkey AS k, CAST(CASE WHEN greatest(c_custkey % 3000, c_custkey * 7 % 2000) / 8.0::DOUBLE >= 200 THEN 8 WHEN greatest(c_custkey % 3000, c_custkey * 7 % 2000) / 4.0::DOUBLE >= 200 THEN 4 WHEN greatest(c_custkey % 3000, c_custkey * 7 % 2000) / 2.0::DOUBLE >= 200 THEN 2 ELSE 1 END AS INT) AS factor FROM customer")
def pyramid_level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsest level that still fills a view (Q12)."""
    k = F.col("c_custkey")
    return X.read(spark, sf_dir, "customer").select(k.alias("k"), S.pyramid_level(k % 3000, k * 7 % 2000, 200).alias("factor"))
