"""Queries over ordered series: running means, crossings, runs, seasons, climatologies, daily indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import config

from ..operators import gates
from ..operators import timeseries as T
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


# Monthly totals of each customer nation's orders: a multi-year series.
_MONTHLY = "monthly AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, avg(o_totalprice) / 9973 AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"
_SERIES = f"{_MONTHLY}, series AS (SELECT *, y * 12 + m AS t FROM monthly)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.read(spark, sf_dir, "orders").join(X.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 9973).alias("v"), F.count("*").alias("n"))
    return out.withColumn("t", F.col("y") * 12 + F.col("m"))


@query(f"WITH {_SERIES} SELECT nation, t, round(CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END, 6) AS running FROM series WINDOW w AS (PARTITION BY nation ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)")
def running_mean_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred twenty-step means, only of whole windows."""
    return rounded(T.running_mean(monthly(spark, sf_dir), ["nation"], "t", "v").select("nation", "t", "running"))


@query(f"WITH {_SERIES}, r AS (SELECT nation, t, CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END AS running FROM series WINDOW w AS (PARTITION BY nation ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)), b AS (SELECT nation, avg(v) AS base FROM series WHERE y <= 1996 GROUP BY 1), l AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 9.0::DOUBLE]) AS level) SELECT nation, level, CAST(coalesce(min(t) FILTER (running - base >= level), 0) AS INT) AS crossed FROM r JOIN b USING (nation), l GROUP BY 1, 2")
def first_crossing_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step at which a running mean is so far above its reference."""
    return T.first_crossings(monthly(spark, sf_dir), ["nation"], "t", "v", F.col("y") <= 1996, [0.1, 0.5, 1.0, 9.0]).select("nation", "level", F.col("crossed").cast("int").alias("crossed"))


@query("WITH e AS (SELECT user_id, event_id, value > 50 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY event_id) AS g FROM events), r AS (SELECT user_id, high, g, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT user_id, coalesce(max(n) FILTER (high), 0) AS longest FROM r GROUP BY 1")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of high values of each user."""
    return T.longest_run(X.read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 50)


@query(f"WITH {_MONTHLY}, s AS (SELECT nation, y + CASE WHEN m = 12 THEN 1 ELSE 0 END AS sy, CAST((m % 12) // 3 AS INT) AS season, v FROM monthly), g AS (SELECT nation, sy, season, sum(v) AS v, count(v) AS n FROM s GROUP BY 1, 2, 3), w AS (SELECT *, sum(n) OVER (PARTITION BY nation, sy) AS months FROM g) SELECT nation, CAST(sy AS INT) AS season_year, season, round(v, 6) AS value FROM w WHERE months = 12")
def seasonal_sums_december_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of years, December counting for the next."""
    return rounded(T.december_shift(monthly(spark, sf_dir), ["nation"], "y", "m", "v"))


@query(f"WITH {_SERIES}, d AS (SELECT nation, t, v, CASE WHEN count(*) OVER p > 1 THEN v - (covar_samp(v, t) OVER p / var_samp(t) OVER p) * (t - avg(t) OVER p) ELSE v END AS r FROM series WINDOW p AS (PARTITION BY nation)) SELECT nation, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(stddev_samp(r) / stddev_samp(v), 6) AS ratio FROM d GROUP BY nation HAVING count(*) >= 10")
def linear_detrend_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread after removal of the linear trend, and its ratio to the raw spread."""
    d = T.detrended(monthly(spark, sf_dir), ["nation"], "t", "v")
    return rounded(d.groupBy("nation").agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"), (F.stddev_samp("residual") / F.stddev_samp("v")).alias("ratio"), F.count("*").alias("n")).where("n >= 10").drop("n"))


@query(f"WITH {_MONTHLY} SELECT nation, m, round(avg(v), 6) AS mean, round(count(DISTINCT y) / 7::DOUBLE, 6) AS share, count(DISTINCT y) / 7::DOUBLE >= 0.95::DOUBLE AS covered FROM monthly GROUP BY 1, 2")
def monthly_climatology_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means and whether enough years are there."""
    return rounded(T.covered_climatology(monthly(spark, sf_dir), ["nation"], "m", "y", "v", 7, config()["climatology"]["coverage"]))


@query(f"WITH {_MONTHLY}, p AS (SELECT nation, y, avg(v) AS mean, sum(n)::BIGINT AS k FROM monthly GROUP BY 1, 2) SELECT nation, round(sum(mean * k) / sum(k), 6) AS mean, CAST(sum(k) AS BIGINT) AS n FROM p GROUP BY 1")
def weighted_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial means merged by their counts (A2)."""
    parts = monthly(spark, sf_dir).groupBy("nation", "y").agg(F.avg("v").alias("mean"), F.sum("n").alias("k"))
    return rounded(T.merged_means(parts, ["nation"], "mean", "k"))


@query(f"WITH {_MONTHLY}, a AS (SELECT y, m, sum(v * (nation + 1)) / sum(nation + 1) AS v FROM monthly GROUP BY 1, 2) SELECT y, round(avg(v), 6) AS mean FROM a GROUP BY y HAVING count(*) = 12")
def area_weighted_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of months, and of the years that have all twelve (A3)."""
    w = F.col("nation") + 1
    a = monthly(spark, sf_dir).groupBy("y", "m").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))
    return rounded(a.groupBy("y").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where("n = 12").drop("n"))


@query("WITH e AS (SELECT l_suppkey AS k, l_partkey % 6 AS model, CASE WHEN l_partkey % 6 = 5 AND l_suppkey % 3 = 0 THEN NULL ELSE avg(l_quantity) END AS v FROM lineitem GROUP BY l_suppkey, l_partkey % 6) SELECT k, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 1) AS low, round(max(v), 1) AS high, round(avg(v) FILTER (model < 4), 6) AS likely, count(v) AS models, count(v) >= 3 AS offered FROM e GROUP BY k")
def ensemble_mean_median_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, medians and ranges over the models that are there, and over a likely subset."""
    e = X.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 6).alias("model")).agg(F.avg("l_quantity").alias("v"))
    e = e.withColumn("v", F.when(~((F.col("model") == 5) & (F.col("k") % 3 == 0)), F.col("v")))
    out = e.groupBy("k").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.round(F.min("v"), 1).alias("low"), F.round(F.max("v"), 1).alias("high"), F.avg(F.when(F.col("model") < 4, F.col("v"))).alias("likely"), F.count("v").alias("models"))
    return rounded(out.withColumn("offered", F.col("models") >= 3))


@query(f"WITH {_MONTHLY}, s AS (SELECT nation, avg(v) FILTER (y <= 1997) AS base, avg(v) FILTER (y >= 1999) AS recent FROM monthly GROUP BY 1) SELECT nation, round(recent - base, 6) AS change, round(ln((base + recent + 1) / (base + 1)), 6) AS log_change FROM s")
def recent_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent years against a baseline of the same data."""
    s = monthly(spark, sf_dir).groupBy("nation").agg(F.avg(F.when(F.col("y") <= 1997, F.col("v"))).alias("b"), F.avg(F.when(F.col("y") >= 1999, F.col("v"))).alias("r"))
    return rounded(s.select("nation", (F.col("r") - F.col("b")).alias("change"), F.log((F.col("b") + F.col("r") + 1) / (F.col("b") + 1)).alias("log_change")))


_DAILY = """
WITH d AS (SELECT user_id, CAST(day(ts) AS INT) AS d, max(value) AS hi, min(value) AS lo, sum(value) AS s FROM events GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - row_number() OVER (PARTITION BY user_id, s < 100 ORDER BY d) AS g FROM d),
r AS (SELECT user_id, max(c) AS dry FROM (SELECT user_id, g, count(*) AS c FROM w WHERE s < 100 GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, round(count(*) FILTER (hi > 100) * 30 / count(*), 6) AS hot, round(count(*) FILTER (lo < 5) * 30 / count(*), 6) AS cold, round(max(s), 6) AS wettest, round(coalesce(max(dry), 0) * 30 / count(*), 6) AS dry_spell FROM d LEFT JOIN r USING (user_id) GROUP BY user_id"""


@query(_DAILY)
def extreme_counts_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of extreme days and the longest dry spell, scaled to a whole period."""
    d = X.read(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("s"))
    runs = T.longest_run(d, ["user_id"], "d", F.col("s") < 100)
    n = F.count("*")
    share = lambda test: F.sum(F.when(test, 1).otherwise(0)) * 30 / n
    out = d.groupBy("user_id").agg(share(F.col("hi") > 100).alias("hot"), share(F.col("lo") < 5).alias("cold"), F.max("s").alias("wettest"), n.alias("n"))
    return rounded(out.join(runs, "user_id").select("user_id", "hot", "cold", "wettest", (F.col("longest") * 30 / F.col("n")).alias("dry_spell")))


@query("WITH s AS (SELECT p_partkey AS k, list_filter([CASE WHEN p_size % 3 <> 0 THEN p_size / 10::DOUBLE END, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 500 END, CASE WHEN p_size % 7 > 3 THEN (p_partkey % 40) / 10::DOUBLE END], lambda x: x IS NOT NULL) AS v FROM part), r AS (SELECT k, list_reverse_sort(v) AS v FROM s) SELECT k, round(CASE WHEN len(v) >= 2 THEN v[2] WHEN len(v) = 1 THEN v[1] END, 6) AS flag, round(CASE WHEN len(v) >= 2 THEN v[2] END, 6) AS agreement, round(v[1], 6) AS worst FROM r")
def corroborated_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-largest source values, with and without a lone source's vote."""
    s = F.col("p_size")
    v = F.array(F.when(s % 3 != 0, s / 10), F.when(s % 5 != 0, F.col("p_retailprice") / 500), F.when(s % 7 > 3, (F.col("p_partkey") % 40) / 10))
    return rounded(X.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), gates.corroborated(v, True).alias("flag"), gates.corroborated(v, False).alias("agreement"), F.array_max(v).alias("worst")))


@query("WITH d AS (SELECT c_nationkey AS g, c_custkey AS k, i - 1 AS measure, ((c_custkey * i * 17) % 101) / 10::DOUBLE AS x FROM customer, range(1, 5) t(i)), m AS (SELECT g, measure, median(x) AS med, count(*) AS n FROM d GROUP BY 1, 2) SELECT k, CAST(measure AS INT) AS measure, round(CASE WHEN n >= 3 THEN x - med ELSE x END, 6) AS rest FROM d JOIN m USING (g, measure)")
def typical_offset_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences less their group's median, where the group has enough rows."""
    c = X.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.posexplode(F.array(*[((F.col("c_custkey") * i * 17) % 101) / 10 for i in range(1, 5)])).alias("measure", "x"))
    m = c.groupBy("g", "measure").agg(F.median("x").alias("med"), F.count("*").alias("n"))
    return rounded(c.join(m, ["g", "measure"]).select("k", "measure", F.when(F.col("n") >= 3, F.col("x") - F.col("med")).otherwise(F.col("x")).alias("rest")))


@query(f"WITH {_MONTHLY} SELECT nation, count(*) AS years, round(avg(v), 6) AS mean FROM (SELECT nation, y, avg(v) AS v FROM monthly WHERE (y - 1995) % 2 = 0 GROUP BY 1, 2) GROUP BY nation")
def strided_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of every second year."""
    m = monthly(spark, sf_dir).where((F.col("y") - 1995) % 2 == 0).groupBy("nation", "y").agg(F.avg("v").alias("v"))
    return rounded(m.groupBy("nation").agg(F.count("*").alias("years"), F.avg("v").alias("mean")))


@query("WITH p AS (SELECT c_nationkey AS nation, c_custkey AS route, CAST(year(o_orderdate) AS INT) AS y FROM orders JOIN customer ON o_custkey = c_custkey) SELECT route FROM p GROUP BY route HAVING count(DISTINCT y) FILTER (y <= 1997) >= 2 AND count(DISTINCT y) FILTER (y >= 1999) >= 2")
def qualifying_two_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with enough years in both windows."""
    o = X.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route"), F.year("o_orderdate").alias("y"))
    n = lambda test: F.countDistinct(F.when(test, F.col("y")))
    return o.groupBy("route").agg(n(F.col("y") <= 1997).alias("a"), n(F.col("y") >= 1999).alias("b")).where("a >= 2 and b >= 2").select("route")


@query("WITH p AS (SELECT l_suppkey % 20 AS state, l_orderkey % 8 AS cycle, l_linenumber % 5 * (l_orderkey % 8 > 0)::INT AS sub, 1980 + CAST(l_orderkey % 8 AS INT) * 5 + CAST(l_orderkey % 3 AS INT) AS y FROM lineitem), g AS (SELECT state, cycle, count(*) AS n, max(sub) AS sub, median(y) AS t FROM p GROUP BY 1, 2), r AS (SELECT state, median(n) AS ref FROM g WHERE sub > 0 GROUP BY 1), c AS (SELECT state, cycle, t FROM g LEFT JOIN r USING (state) WHERE sub = 0 OR n >= 0.85::DOUBLE * ref) SELECT state, min(cycle) AS first, max(cycle) AS last, round(max(t) - min(t), 6) AS years, count(*) >= 2 AND max(t) - min(t) >= 15 AS ok FROM c GROUP BY state")
def complete_cycles_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last complete survey cycles of each state."""
    k = F.col("l_orderkey")
    p = X.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("state"), (k % 8).alias("cycle"), F.when(k % 8 > 0, F.col("l_linenumber") % 5).otherwise(0).alias("sub"), (1980 + (k % 8) * 5 + k % 3).alias("y"))
    from ..operators.survey import complete_cycles

    return rounded(complete_cycles(p, "state", "cycle", "sub", "y", config()["hindcast"]["complete"], config()["hindcast"]["min_interval"]))


@query("WITH b AS (SELECT l_partkey % 300 // 12 AS block_row, l_suppkey // 12 AS block_col, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS p1, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS p2 FROM lineitem GROUP BY 1, 2) SELECT CAST(block_row AS INT) AS block_row, CAST(block_col AS INT) AS block_col, p1, p2, p1 >= 200 AND p2 >= 200 AS well, p1 >= 250 AND p2 >= 250 AS strict FROM b")
def well_sampled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effort by block and period, and the blocks with enough of both."""
    from ..operators.survey import effort_blocks

    li = X.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("grid_row"), F.col("l_suppkey").alias("grid_col"), F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), 1).otherwise(2).alias("period"))
    e = effort_blocks(li, "period", 12)
    return e.withColumn("well", (F.col("p1") >= 200) & (F.col("p2") >= 200)).withColumn("strict", (F.col("p1") >= 250) & (F.col("p2") >= 250))


_RARE = """
WITH p AS (SELECT l_partkey % 30 AS block, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS win, l_quantity > 49 AS seen, l_orderkey * 10 + l_linenumber AS plot FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY block, win ORDER BY (plot * 48271) % 2147483647, plot) AS k, count(*) OVER (PARTITION BY block, win) AS n FROM p),
s AS (SELECT block, least(min(n) FILTER (win = 1), min(n) FILTER (win = 2), 30) AS take FROM r GROUP BY 1)
SELECT block, CAST(take AS BIGINT) AS plots, bool_or(seen) FILTER (win = 1) AS before, bool_or(seen) FILTER (win = 2) AS after FROM r JOIN s USING (block) WHERE k <= take AND take >= 8 GROUP BY 1, 2"""


@query(_RARE)
def rarefied_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence among equally many plots of both windows, drawn by a hash."""
    from ..operators.survey import rarefied

    p = X.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 30).alias("block"), F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), 1).otherwise(2).alias("win"), (F.col("l_quantity") > 49).alias("seen"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("plot"))
    return rarefied(p, "block", "win", "seen", (F.col("plot") * 48271) % 2147483647, "plot", config()["hindcast"]["plot_cap"], config()["hindcast"]["min_plots"])


_DETECT = "WITH d AS (SELECT DISTINCT l_suppkey AS route, l_partkey % 9 AS species, CAST(year(l_shipdate) AS INT) AS y FROM lineitem), c AS (SELECT route, species, count(*) FILTER (y <= 1997) AS a, count(*) FILTER (y >= 1999) AS b FROM d GROUP BY 1, 2) SELECT route, species, a, b, a >= 3 AS p1, b >= 3 AS p2 FROM c"


@query(_DETECT)
def detections_two_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct years of detection by route, species and window."""
    from ..operators.survey import detections

    d = X.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route"), (F.col("l_partkey") % 9).alias("species"), F.year("l_shipdate").alias("y"))
    return detections(d, (0, 1997), (1999, 9999), config()["hindcast"]["min_detections"])


@query(f"WITH {X.CLIMATE_SQL}, w AS (SELECT c.place_id, row_number() OVER (PARTITION BY place_id ORDER BY tmax DESC, m) AS k, m FROM climate c) SELECT place_id, list(m ORDER BY k) AS warmest FROM (SELECT place_id, CAST(m AS INT) AS m, k FROM w WHERE k <= 3) GROUP BY place_id")
def warmest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three warmest months of each place, by array sorting (T10, array family)."""
    c = X.climate(spark, sf_dir)
    order = F.array_sort(F.transform("tmax", lambda x, i: F.struct((-x).alias("x"), (i + 1).alias("m"))))
    return c.select("place_id", F.transform(F.slice(order, 1, 3), lambda s: s["m"]).alias("warmest"))


@query("SELECT o_custkey, first_value(o_orderkey) OVER w AS first_order, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 4) AS spent, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of ordered rows (ordered operators)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(X.read(spark, sf_dir, "orders").select("o_custkey", F.first("o_orderkey").over(w).alias("first_order"), F.count("*").over(w).alias("n"), F.sum("o_totalprice").over(w).alias("spent"), "o_orderkey"), 4)


