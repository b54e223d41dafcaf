"""Queries over cleaning, cells, routing, ranks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..functions.geo import cell_col, cell_row
from ..operators import gates
from ..operators import occurrence as O
from ..operators import timeseries as T
from ..operators.ordering import ranked
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


_OK = "coalesce(abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (abs(lat) < 0.0001::DOUBLE AND abs(lon) < 0.0001::DOUBLE) AND lat <> lon AND NOT (lat = round(lat) AND lon = round(lon)), false)"
_CERTAIN = "NOT coalesce(uncertainty > 10000, false)"
_WILD = "NOT (upper(coalesce(established, '')) IN ('MANAGED','CULTIVATED','CAPTIVE','VAGRANT','INVASIVE','NATURALISED','NATURALIZED') OR starts_with(upper(coalesce(established, '')), 'INTRODUCED'))"
CLEAN = f"{X.RECORDS_SQL}, clean AS (SELECT *, CAST(least(greatest(floor((90 - lat) * 24), 0), 4319) AS INT) AS grid_row, CAST((floor((lon + 180) * 24) % 8640 + 8640) % 8640 AS INT) AS grid_col FROM records WHERE {_OK} AND {_CERTAIN} AND {_WILD} AND year IS NOT NULL)"
STEPS = (("coords", lambda: O.valid_coordinates(F.col("lat"), F.col("lon"))), ("uncertainty", lambda: O.certain(F.col("uncertainty"))), ("establishment", lambda: O.wild(F.col("established"))), ("year", lambda: F.col("year").isNotNull()))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.lit(True)
    for _, t in STEPS:
        test = test & t()
    return X.records(spark, sf_dir).where(test)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each data set and identity: the first by record_id."""
    return O.first_by(clean(spark, sf_dir), ["dataset", "identity"], F.col("record_id"), F.col("lat"), F.col("lon"))


DEDUP = f"{CLEAN}, dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, identity ORDER BY record_id, lat, lon) AS k FROM clean) WHERE k = 1)"


@query(f"WITH {X.RECORDS_SQL}, t AS (SELECT {_OK} AS a, {_CERTAIN} AS b, {_WILD} AS c, year IS NOT NULL AS d FROM records) SELECT CAST(step_no AS INT) AS step_no, step, \"left\" FROM (SELECT 0 AS step_no, 'input' AS step, count(*) AS \"left\" FROM t UNION ALL SELECT 1, 'coords', count(*) FILTER (a) FROM t UNION ALL SELECT 2, 'uncertainty', count(*) FILTER (a AND b) FROM t UNION ALL SELECT 3, 'establishment', count(*) FILTER (a AND b AND c) FROM t UNION ALL SELECT 4, 'year', count(*) FILTER (a AND b AND c AND d) FROM t)")
def clean_loss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records left after each cleaning step."""
    return O.loss_report(X.records(spark, sf_dir), [(n, t()) for n, t in STEPS])


@query(f"WITH {DEDUP} SELECT (SELECT count(*) FROM clean) AS records, (SELECT count(*) FROM dedup) AS identities, (SELECT count(*) FROM (SELECT DISTINCT round(lat, 5), round(lon, 5), year, month, dataset FROM clean)) AS events")
def dedup_identity_vs_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rules of identity side by side (dedup rules, A12)."""
    event = F.struct(F.round("lat", 5).alias("a"), F.round("lon", 5).alias("b"), "year", "month", "dataset")
    return clean(spark, sf_dir).agg(F.count("*").alias("records"), F.countDistinct(F.struct("dataset", "identity")).alias("identities"), F.countDistinct(event).alias("events"))


@query(f"WITH {CLEAN} SELECT grid_row, grid_col, record_id, uncertainty FROM (SELECT *, row_number() OVER (PARTITION BY grid_row, grid_col ORDER BY uncertainty ASC NULLS LAST, record_id) AS k FROM clean) WHERE k = 1")
def thin_best_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most certain record of each cell, the first on ties."""
    at = clean(spark, sf_dir).withColumn("grid_row", cell_row(F.col("lat"))).withColumn("grid_col", cell_col(F.col("lon")))
    return O.first_by(at, ["grid_row", "grid_col"], F.col("uncertainty").asc_nulls_last(), F.col("record_id")).select("grid_row", "grid_col", "record_id", "uncertainty")


@query(f"WITH {DEDUP} SELECT grid_row, grid_col, min(year) AS year_min, max(year) AS year_max, count(*) AS n_records, count(DISTINCT (lat, lon, coalesce(month, -1), year)) AS n_events, count(*) FILTER (year BETWEEN 1970 AND 1999) AS n_1970_1999, count(*) FILTER (year BETWEEN 2000 AND 2020) AS n_2000_2020, count(*) FILTER (year > 2020) AS n_2021_plus FROM dedup GROUP BY 1, 2")
def cells_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to cells with events and periods."""
    return O.to_cells(deduplicated(spark, sf_dir).withColumn("month", F.coalesce("month", F.lit(-1))), ["lat", "lon", "month", "year"])


@query(f"WITH {DEDUP} SELECT grid_row, grid_col, " + ", ".join(f"count(*) FILTER (coalesce(month, 0) = {m}) AS m{m:02d}" for m in range(13)) + ", count(*) FILTER (month IN (5,6,7)) AS n_breeding, count(*) FILTER (month IN (5,6,7) AND year BETWEEN 1970 AND 1999) AS n_breeding_1970_1999, count(*) FILTER (month IN (5,6,7) AND year BETWEEN 2000 AND 2020) AS n_breeding_2000_2020, count(*) FILTER (month IN (12,1,2)) AS n_winter, count(*) FILTER (month IN (12,1,2) AND year BETWEEN 1970 AND 1999) AS n_winter_1970_1999, count(*) FILTER (month IN (12,1,2) AND year BETWEEN 2000 AND 2020) AS n_winter_2000_2020 FROM dedup GROUP BY 1, 2")
def season_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and season counts of cells."""
    return O.season_counts(deduplicated(spark, sf_dir))


@query("SELECT kind, value, n FROM (SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS k FROM events GROUP BY user_id UNION ALL SELECT 'type', event_type, count(*), row_number() OVER (ORDER BY count(*) DESC, event_type) FROM events GROUP BY event_type) WHERE k <= 15")
def value_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values, the fifteen largest of each kind."""
    e = X.read(spark, sf_dir, "events")
    top = lambda kind, c: e.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(15).select(F.lit(kind).alias("kind"), "value", "n")
    return top("user", "user_id").unionByName(top("type", "event_type"))


@query("SELECT n_name, r_name, count(c_custkey) AS customers, coalesce(bool_or(c_acctbal > 9000), false) AS rich FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 8000 GROUP BY 1, 2")
def routes_presence_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with missing as false and zero."""
    c = X.read(spark, sf_dir, "customer").where("c_acctbal > 8000").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.bool_or(F.col("c_acctbal") > 9000).alias("rich"))
    n = X.read(spark, sf_dir, "nation").join(X.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("rich", F.lit(False)).alias("rich"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'EUROPE' WHEN r_name IS NOT NULL AND n_regionkey < 3 THEN r_name ELSE 'unknown' END AS continent, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def continent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through two look-ups with an unknown bucket."""
    c = X.read(spark, sf_dir, "customer").join(X.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(X.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    name = F.when(F.col("c_custkey") % 3 == 0, "EUROPE").when(F.col("r_name").isNotNull() & (F.col("n_regionkey") < 3), F.col("r_name")).otherwise("unknown")
    return c.groupBy(name.alias("continent")).agg(F.count("*").alias("n"))


_ROUTES = "keys AS (SELECT 'p_partkey' AS kind, CAST(p_partkey AS VARCHAR) AS value, 'key' || (p_partkey % 7) AS target FROM part WHERE p_size <= 5 UNION ALL SELECT DISTINCT 'p_brand', p_brand, 'brand' FROM part WHERE p_size = 50 AND p_retailprice > 1500 UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR), 'size' || p_size FROM part WHERE p_size < 10)"


@query(f"WITH {_ROUTES} SELECT p_partkey, coalesce((SELECT min(target) FROM keys WHERE kind = 'p_partkey' AND value = CAST(p_partkey AS VARCHAR)), (SELECT min(target) FROM keys WHERE kind = 'p_brand' AND value = p_brand), (SELECT min(target) FROM keys WHERE kind = 'p_size' AND value = CAST(p_size AS VARCHAR))) AS target FROM part")
def route_by_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to targets by key, else by name, else by class."""
    p = X.read(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    keys = p.where("p_size <= 5").select(F.lit("p_partkey").alias("kind"), text("p_partkey").alias("value"), F.concat(F.lit("key"), (F.col("p_partkey") % 7).cast("string")).alias("target"))
    keys = keys.unionByName(p.where("p_size = 50 and p_retailprice > 1500").select(F.lit("p_brand").alias("kind"), F.col("p_brand").alias("value"), F.lit("brand").alias("target")).distinct())
    keys = keys.unionByName(p.where("p_size < 10").select(F.lit("p_size").alias("kind"), text("p_size").alias("value"), F.concat(F.lit("size"), text("p_size")).alias("target")).distinct())
    return O.route_rows(p, keys, ["p_partkey", "p_brand", "p_size"]).select("p_partkey", "target")


@query("WITH a AS (SELECT c_nationkey AS k, c_custkey AS v, 0 AS source_no FROM customer WHERE c_acctbal < -900 UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier UNION ALL SELECT n_nationkey, -1, 2 FROM nation) SELECT k, v, source_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_no, v) AS n FROM a) WHERE n = 1")
def union_priority_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union in which the first source wins (set operations, H17)."""
    a = X.read(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    b = X.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    c = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return O.priority_union([a, b, c], ["k"], ["v"]).select("k", "v", "source_no")


@query("SELECT k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def member_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that all sets have, less an excluded set (set algebra)."""
    a = X.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    b = X.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k"))
    out = X.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return a.join(b, "k", "left_semi").distinct().join(out, "k", "left_anti")


_FOLD = "lower(regexp_replace(translate(c_name, 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'), '[^0-9A-Za-z]+', ' ', 'g'))"


@query(f"SELECT c_custkey, c_name, CAST(CASE WHEN starts_with({_FOLD}, '0000000') THEN 0 WHEN contains({_FOLD}, ' 0000001') THEN 1 ELSE 2 END AS INT) AS rank FROM customer WHERE contains({_FOLD}, '0000001') OR starts_with({_FOLD}, '0000001') ORDER BY rank, c_name LIMIT 120")
def text_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search combo: prefixes of the label, of its words, then anywhere."""
    return O.search_rank(X.read(spark, sf_dir, "customer"), "c_name", "0000001").select("c_custkey", "c_name", "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_version_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    return T.latest_version(X.read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH v AS (SELECT p_partkey, log10(1 + coalesce(p_size, 0)) AS x FROM part) SELECT p_partkey, round(((rank() OVER (ORDER BY x) - 1) / (count(*) OVER ())::DOUBLE + cume_dist() OVER (ORDER BY x)) / 2, 6) AS popularity, round(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2, 6) AS r FROM v")
def popularity_mid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentiles and averaged ranks."""
    p = X.read(spark, sf_dir, "part").select("p_partkey", F.log10(1 + F.coalesce("p_size", F.lit(0))).alias("x"))
    return rounded(ranked(p, "x").select("p_partkey", F.col("mid").alias("popularity"), F.col("rank").alias("r")))


_GATE = """
WITH s AS (SELECT p_partkey AS k, CAST(p_partkey % 700 AS INT) AS n, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE (p_partkey * 7 % 60) / 100::DOUBLE + 0.4::DOUBLE END AS auc, (p_partkey * 11 % 100) / 100::DOUBLE AS boyce, CASE WHEN p_partkey % 53 = 0 THEN 0 ELSE (p_partkey % 300) * 500::DOUBLE END AS area, (p_partkey * 3 % 100) / 100::DOUBLE AS recall, CASE WHEN p_partkey % 17 = 0 THEN 'missing' WHEN p_partkey % 19 = 0 THEN 'fail' ELSE 'pass' END AS status, (p_partkey * 13 % 100) / 100::DOUBLE AS unrecorded, (p_partkey * 5 % 60) * 1::DOUBLE AS gap, p_partkey % 4 = 0 AS survey FROM part),
g AS (SELECT *, coalesce((auc >= 0.7::DOUBLE AND boyce >= 0.5::DOUBLE) OR (auc >= 0.6::DOUBLE AND boyce >= 0.8::DOUBLE), false) AS skilled,
 list_filter([CASE WHEN n < 100 THEN 'records' END, CASE WHEN auc IS NULL THEN 'no skill' WHEN auc < 0.5::DOUBLE THEN 'skill below floor' END, CASE WHEN status = 'missing' THEN 'no range check' WHEN status = 'fail' THEN 'range check failed' END, CASE WHEN area <= 0 THEN 'empty range' WHEN recall < 0.8::DOUBLE THEN 'recall' END], lambda x: x IS NOT NULL) AS hard,
 list_filter([CASE WHEN n >= 100 AND n < 300 THEN 'few records' END, CASE WHEN area < 67500 AND n >= 100 AND n < 500 THEN 'narrow range' END, CASE WHEN auc >= 0.5::DOUBLE AND auc < 0.7::DOUBLE THEN 'low discrimination' END, CASE WHEN unrecorded > 0.5::DOUBLE THEN 'unrecorded area' END, CASE WHEN gap > 25 THEN 'check model disagrees' END], lambda x: x IS NOT NULL) AS soft FROM s),
t AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'C' WHEN survey THEN 'A' ELSE 'B' END AS tier FROM g)
SELECT k, tier, CASE WHEN tier <> 'C' AND len(soft) > 0 THEN 'low' ELSE 'standard' END AS confidence, skilled OR tier = 'A' AS publishable, array_to_string(hard, ';') AS hard, array_to_string(soft, ';') AS soft, CASE WHEN tier = 'C' THEN 'not shown' WHEN tier = 'A' AND len(soft) = 0 THEN 'well supported' WHEN len(soft) > 0 THEN 'uncertain' ELSE 'supported' END AS grade FROM t"""


@query(_GATE)
def publication_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, tiers, confidence, the publication rule and reliability grades."""
    k = F.col("p_partkey")
    s = X.read(spark, sf_dir, "part").select(
        k.alias("k"), (k % 700).cast("int").alias("n"), F.when(k % 41 != 0, (k * 7 % 60) / 100 + 0.4).alias("auc"), ((k * 11 % 100) / 100).alias("boyce"), F.when(k % 53 == 0, F.lit(0.0)).otherwise((k % 300) * 500.0).alias("area"), ((k * 3 % 100) / 100).alias("recall"),
        F.when(k % 17 == 0, "missing").when(k % 19 == 0, "fail").otherwise("pass").alias("status"), ((k * 13 % 100) / 100).alias("unrecorded"), ((k * 5 % 60) * 1.0).alias("gap"), (k % 4 == 0).alias("survey"),
    )
    g = gates.evaluate(s, config()["gates"])
    return g.select("k", "tier", "confidence", "publishable", F.array_join("hard", ";").alias("hard"), F.array_join("soft", ";").alias("soft"), "grade")


_RELEASE = """
WITH p AS (SELECT c_custkey AS k, c_nationkey AS g, (c_custkey * 7 % 100) / 40::DOUBLE AS before FROM customer), n AS (SELECT c_custkey AS k, (c_custkey * 7 % 100) / 40::DOUBLE + (c_custkey % 13) / 50::DOUBLE AS after, c_custkey % 11 = 0 AS moved FROM customer WHERE c_custkey % 29 <> 0)
SELECT g, count(*) AS n, round(avg(CASE WHEN moved THEN 1 ELSE 0 END), 6) AS moved_share, round(median(abs(after - before)), 6) AS change, avg(CASE WHEN moved THEN 1 ELSE 0 END) <= 0.10::DOUBLE AND median(abs(after - before)) <= 0.25::DOUBLE AS routine FROM p JOIN n USING (k) GROUP BY g"""


@query(_RELEASE)
def release_comparison_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This release against the previous one, by group."""
    c, k = X.read(spark, sf_dir, "customer"), F.col("c_custkey")
    before = c.select(k.alias("k"), F.col("c_nationkey").alias("g"), ((k * 7 % 100) / 40).alias("before"))
    after = c.where("c_custkey % 29 <> 0").select(k.alias("k"), ((k * 7 % 100) / 40 + (k % 13) / 50).alias("after"), (k % 11 == 0).alias("moved"))
    return rounded(gates.release_report(before.join(after, "k"), ["g"], config()["release"]))


@query("SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS rich, round(count(*) FILTER (c_acctbal > 5000) / count(*), 6) AS share, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(quantile_cont(c_acctbal, 0.95), 4) AS p95 FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def quantile_share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, exact percentiles and shares over thresholds, with totals."""
    c = X.read(spark, sf_dir, "customer")
    q = lambda p: F.percentile("c_acctbal", F.lit(p))
    rich = F.sum(F.when(F.col("c_acctbal") > 5000, 1).otherwise(0))
    out = c.rollup(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), rich.alias("rich"), (rich / F.count("*")).alias("share"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"))
    return out.select("segment", "nation", "n", "rich", F.round("share", 6).alias("share"), *[F.round(x, 4).alias(x) for x in ("median", "p90", "p95")])


_TAX = """
WITH s AS (SELECT p_type AS family, p_brand AS genus, p_partkey AS species FROM part), g AS (SELECT family, genus, count(*) AS n FROM s GROUP BY ROLLUP (family, genus)), k AS (SELECT family, count(*) AS kids FROM g WHERE genus IS NOT NULL GROUP BY family)
SELECT g.family, g.genus, g.n, coalesce(kids = 1 AND g.genus IS NOT NULL, false) AS squashed FROM g LEFT JOIN k USING (family)"""


@query(_TAX)
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of counts whose only children are squashed (Q10)."""
    g = X.read(spark, sf_dir, "part").rollup(F.col("p_type").alias("family"), F.col("p_brand").alias("genus")).agg(F.count("*").alias("n"))
    kids = g.where("genus is not null").groupBy(F.col("family").alias("f")).agg(F.count("*").alias("kids"))
    return g.join(kids, F.col("family") == F.col("f"), "left").select("family", "genus", "n", F.coalesce((F.col("kids") == 1) & F.col("genus").isNotNull(), F.lit(False)).alias("squashed"))


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS DOUBLE) AS k FROM events GROUP BY 1, 2")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed and summed (JSON family, S29)."""
    e = X.read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("k").cast("double"), 6).alias("k"))


@query("SELECT conv_id, turn, role, coalesce(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text), length(text)) AS delta, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT % 256 AS code FROM conversations")
def delta_code_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row differences and running sums modulo 256."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.length("text").cast("long")
    return X.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(n - F.lag(n).over(w), n).alias("delta"), (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 256).alias("code"))
