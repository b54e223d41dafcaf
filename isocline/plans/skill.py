"""Queries over nearest analogues, variability metrics, ranges, skill and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..functions import climate as C
from ..functions import geo as G
from ..functions import numeric
from ..operators import metric as M
from ..operators import models as D
from ..operators import occurrence as O
from ..operators import ranges as R
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


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the search pool."""
    return X.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("near"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target for each label: the mean vector."""
    long = pool(spark, sf_dir).select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return long.groupBy(F.col("label").alias("target")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("target", F.transform("v", lambda s: s["x"]).alias("vec"))


_MEANS = "long AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), means AS (SELECT label AS target, i, avg(x) AS x FROM long GROUP BY 1, 2), dist AS (SELECT target, vec_id AS near, sqrt(sum((l.x - m.x) * (l.x - m.x))) AS d FROM long l JOIN means m USING (i) GROUP BY 1, 2)"


@query(f"WITH {_MEANS} SELECT CAST(target AS BIGINT) AS target, near, round(d, 6) AS distance, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, near) AS k FROM dist) WHERE k <= 1")
def analog_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool vector nearest to each label's mean (J6, T1): the flagship."""
    return rounded(M.nearest_rows(label_means(spark, sf_dir), pool(spark, sf_dir), k=1, exclude_same=False))


@query(f"WITH {_MEANS} SELECT CAST(target AS BIGINT) AS target, count(*) FILTER (d < 1.0::DOUBLE) AS cells, CAST(coalesce(sum(near % 7 + 1) FILTER (d < 1.0::DOUBLE), 0) AS DOUBLE) AS area FROM dist GROUP BY 1")
def analog_area_under_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the pool within a distance of each target."""
    return rounded(M.area_within(label_means(spark, sf_dir), pool(spark, sf_dir).withColumn("weight", F.col("near") % 7 + 1), 1.0))


_SHARE = f"""
WITH b AS (SELECT s_suppkey AS place, i AS model, (s_suppkey * (i + 3) * 53 % 1100) / 10::DOUBLE - 55 AS lat, ((s_suppkey * 733 + i * 7) % 3600) / 10::DOUBLE - 180 AS lon FROM supplier, range(0, 8) t(i)),
e AS (SELECT place, lat AS elat, lon AS elon FROM b WHERE model = 0)
SELECT place, round(avg(CASE WHEN 2 * {EARTH}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(elat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(elat)) * pow(sin(radians(elon - lon) / 2), 2)))) <= 500 THEN 1 ELSE 0 END), 6) AS share FROM b JOIN e USING (place) WHERE model > 0 GROUP BY place"""


@query(_SHARE)
def analog_agreement_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of models whose best match is near the ensemble's."""
    k, i = F.col("s_suppkey"), F.col("model")
    b = X.read(spark, sf_dir, "supplier").withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(k.alias("place"), "model", ((k * (i + 3) * 53 % 1100) / 10 - 55).alias("lat"), (((k * 733 + i * 7) % 3600) / 10 - 180).alias("lon"))
    e = b.where("model = 0").select("place", F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    return rounded(b.where("model > 0").join(e, "place").groupBy("place").agg(F.avg(F.when(km <= config()["matching"]["agree_km"], 1).otherwise(0)).alias("share")))


@query()
def analog_spaced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five spaced sites among the nearest pool vectors of each target."""
    p = pool(spark, sf_dir).withColumn("lat", (F.col("near") * 37 % 1100) / 10 - 55).withColumn("lon", (F.col("near") * 911 % 3600) / 10 - 180)
    near = M.nearest_rows(label_means(spark, sf_dir), p.select("near", "vec"), k=200, exclude_same=False)
    return rounded(M.spaced_sites(near.join(p.select("near", "lat", "lon"), "near"), "target", 5, 1500.0))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as a series of years, of their first six measures."""
    return X.read(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("place"), F.col("vec_id").alias("year"), F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("vec"))


@query()
def place_metric_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening matrices of shrunk correlations, one for each place (M4, M6)."""
    out = M.place_metrics(_series(spark, sf_dir))
    return rounded(out.select("place", "k", F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x).alias("norm"), "shrinkage", "floored"))


@query()
def place_metric_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitening matrices of the leading components (M5)."""
    return rounded(M.place_metrics(_series(spark, sf_dir), "truncated").select("place", "k", F.size("m").alias("n"), "floored"))


@query()
def analog_metric_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row in each place's own metric, as a sigma."""
    s = _series(spark, sf_dir)
    m = M.place_metrics(s).select(F.col("place").alias("target"), "k", "m")
    means = s.select("place", F.posexplode("vec").alias("i", "x")).groupBy("place", "i").agg(F.avg("x").alias("x")).groupBy(F.col("place").alias("target")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("target", F.transform("v", lambda r: r["x"] + 0.5).alias("vec"))
    near = M.nearest_rows(means.join(m, "target"), s.select(F.col("year").alias("near"), "vec"), exclude_same=False).join(m.select("target", "k"), "target")
    return rounded(M.with_sigma(near, M.sigma_table(spark), "distance", "k").select("target", "near", "distance", "k", "sigma"), 4)


def _even_tail() -> str:
    terms = " + ".join(f"pow(h, {i}) / {np.prod(range(1, i + 1), dtype=float) if i else 1.0}" for i in range(7))
    return f"exp(-h) * ({terms})"


@query(f"WITH t AS (SELECT i, i * 0.02::DOUBLE AS d, pow(i * 0.02::DOUBLE, 2) / 2 AS h FROM range(50, 300) r(i)) SELECT CAST(i AS INT) AS i, round({_even_tail()}, 8) AS tail FROM t")
def sigma_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of 14 measures' distances, checked against its closed form (M1, M2, M3)."""
    rows = pd.DataFrame([(i, round(float(np.exp(numeric.log_chi_square_tail((i * 0.02) ** 2, 14))), 8)) for i in range(50, 300)], columns=["i", "tail"])
    return spark.createDataFrame(rows, "i int, tail double")


@query()
def marginal_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances on a subset of the measures (M9)."""
    m = M.place_metrics(_series(spark, sf_dir))

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        return x.map(lambda v: numeric.marginal_distance(np.asarray(v).reshape(6, 6), np.full(6, 0.1), [0, 1, 2]))

    return rounded(m.select("place", distance("m").alias("distance")))


@query()
def growing_degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree days from daily curves."""
    c = X.climate(spark, sf_dir).select("place_id", "tmax", "tmin")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"place_id": f.place_id, "gdd": numeric.growing_degree_days(np.stack(f.tmax), np.stack(f.tmin))})

    return rounded(c.mapInPandas(run, "place_id long, gdd double"), 4)


@query()
def water_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A soil bucket with a snow store over three equal years."""
    c = X.climate(spark, sf_dir).select("place_id", "tmax", "tmin", "ppt", C.hargreaves_pet(F.col("tmax"), F.col("tmin"), F.col("lat")).alias("pet"))

    def run(frames):
        for f in frames:
            rain, pet = np.stack(f.ppt), np.stack(f.pet)
            aet, cwd = numeric.water_balance(rain, pet, (np.stack(f.tmax) + np.stack(f.tmin)) / 2, np.full(len(f), 100.0))
            yield pd.DataFrame({"place_id": f.place_id, "aet": aet.sum(axis=1), "cwd": cwd.sum(axis=1)})

    return rounded(c.mapInPandas(run, "place_id long, aet double, cwd double"), 4)


def _xyz(state: str) -> str:
    w = f"FILTER ({state})"
    return f"sum(km2 * cos(radians(lat)) * cos(radians(lon))) {w} AS x, sum(km2 * cos(radians(lat)) * sin(radians(lon))) {w} AS y, sum(km2 * sin(radians(lat))) {w} AS z"


_CENTROID = f"""
WITH {X.CELLS_SQL}, a AS (SELECT species, {_xyz('now')} FROM cells GROUP BY 1), b AS (SELECT species, {_xyz('later')} FROM cells GROUP BY 1),
c AS (SELECT species, degrees(atan2(a.z, sqrt(a.x * a.x + a.y * a.y))) AS lat0, degrees(atan2(a.y, a.x)) AS lon0, degrees(atan2(b.z, sqrt(b.x * b.x + b.y * b.y))) AS lat1, degrees(atan2(b.y, b.x)) AS lon1 FROM a JOIN b USING (species))
SELECT species, round(lat0, 6) AS lat0, round(lon0, 6) AS lon0, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(2 * {EARTH}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon0) / 2), 2)))), 5) AS shift_km FROM c"""


@query(_CENTROID)
def range_centroid_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of two states and their distance."""
    out = R.change_summary(X.cells(spark, sf_dir), ["species"])
    return out.select("species", *[F.round(c, 6).alias(c) for c in ("lat0", "lon0", "lat1", "lon1")], F.round("shift_km", 5).alias("shift_km"))


@query(f"WITH {X.CELLS_SQL} SELECT species, round(sum(km2) FILTER (now), 6) AS area_now, round(sum(km2) FILTER (later), 6) AS area_later, round((sum(km2) FILTER (later) / sum(km2) FILTER (now) - 1) * 100, 6) AS change_pct, round(coalesce(sum(km2) FILTER (later AND NOT now), 0), 6) AS gain, round(coalesce(sum(km2) FILTER (now AND NOT later), 0), 6) AS loss, round(coalesce(sum(km2) FILTER (now AND later), 0), 6) AS stable FROM cells GROUP BY 1")
def range_gain_loss_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas gained, lost and kept."""
    return rounded(R.change_summary(X.cells(spark, sf_dir), ["species"]).select("species", "area_now", "area_later", "change_pct", "gain", "loss", "stable"))


@query(f"WITH {X.CELLS_SQL}, s AS (SELECT species, coalesce(sum(km2) FILTER (now AND later), 0) AS tp, coalesce(sum(km2) FILTER (now AND NOT later), 0) AS fp, coalesce(sum(km2) FILTER (later AND NOT now), 0) AS fn, coalesce(sum(km2) FILTER (NOT now AND NOT later), 0) AS tn FROM cells GROUP BY 1) SELECT species, round(tp / (tp + fn), 6) AS sens, round(tn / (tn + fp), 6) AS spec, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS tss, round(2 * tp / (2 * tp + fp + fn), 6) AS sorensen, round(fp / (tp + fn), 6) AS commission, round(fn / (tp + fn), 6) AS omission FROM s")
def confusion_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted agreement of two ranges."""
    return rounded(R.agreement(X.cells(spark, sf_dir), ["species"], "now", "later"))


_EDGES = f"WITH {X.CELLS_SQL}, v AS (SELECT species, lat, sum(km2) AS w FROM cells WHERE now GROUP BY 1, 2), c AS (SELECT species, lat, sum(w) OVER (PARTITION BY species ORDER BY lat) / sum(w) OVER (PARTITION BY species) AS share FROM v) SELECT species, round(min(lat) FILTER (share >= 0.05::DOUBLE), 6) AS edge_low, round(min(lat) FILTER (share >= 0.95::DOUBLE), 6) AS edge_high FROM c GROUP BY 1"


@query(_EDGES)
def weighted_latitude_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes of the 5th and 95th area percentiles."""
    return rounded(R.latitude_edges(X.cells(spark, sf_dir), ["species"], "now"))


@query(f"WITH {X.CELLS_SQL}, b AS (SELECT species, CAST(floor(lat / 2) * 2 AS INT) AS band, score, km2 FROM cells) SELECT species, band, count(*) AS n, round(sum(score * km2) / sum(km2), 6) AS mean FROM b GROUP BY GROUPING SETS ((species, band), (species))")
def latitude_band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means by latitude band, with a row for all."""
    c = X.cells(spark, sf_dir).withColumn("band", (F.floor(F.col("lat") / 2) * 2).cast("int"))
    sets = c.groupingSets([["species", "band"], ["species"]], "species", "band")
    return rounded(sets.agg(F.count("*").alias("n"), (F.sum(F.col("score") * F.col("km2")) / F.sum("km2")).alias("mean")))


@query(f"WITH {X.CELLS_SQL} SELECT species, round(avg(score - km2 / 22), 6) AS bias, round(avg(abs(score - km2 / 22)), 6) AS mae, round(sqrt(avg(pow(score - km2 / 22, 2))), 6) AS rmse, round(corr(score, km2), 6) AS r FROM cells GROUP BY 1")
def bias_mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of one measure against another."""
    e = F.col("score") - F.col("km2") / 22
    return rounded(X.cells(spark, sf_dir).groupBy("species").agg(F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("score", "km2").alias("r")))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cells(spark, sf_dir).withColumn("cluster", F.floor(F.col("grid_row") / 12) * 1000 + F.floor(F.col("grid_col") / 12))


@query()
def bootstrap_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of range shifts."""
    return rounded(R.resampled_shift(_clustered(spark, sf_dir), "species").select("species", "km", "se", "low", "high", "detectable"))


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-swap tests of range shifts."""
    return rounded(R.resampled_shift(_clustered(spark, sf_dir), "species").select("species", "km", "p"))


_SCORED = "scored AS (SELECT doc_id, quality, CAST(n_chars % 977 AS DOUBLE) / 977 AS s, lang FROM documents JOIN labels USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(X.read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", ((F.col("n_chars") % 977).cast("double") / 977).alias("s"), "lang")


@query(f"WITH {_SCORED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r FROM scored), t AS (SELECT lang, sum(r) FILTER (quality = 1) AS w, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS m FROM r GROUP BY 1) SELECT lang, round(CASE WHEN n > 0 AND m > 0 THEN (w - n * (n + 1) / 2) / (n * m) END, 6) AS auc FROM t")
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the curve by rank sums."""
    return rounded(D.auc(scored(spark, sf_dir), "s", F.col("quality") == 1, ["lang"]))


@query(f"WITH {_SCORED}, c AS (SELECT DISTINCT s AS threshold FROM scored), t AS (SELECT threshold, avg(CASE WHEN s >= threshold THEN 1 ELSE 0 END) FILTER (quality = 1) AS sens, avg(CASE WHEN s < threshold THEN 1 ELSE 0 END) FILTER (quality = 0) AS spec FROM c, scored GROUP BY 1) SELECT round(threshold, 6) AS threshold, round(sens, 6) AS sens, round(spec, 6) AS spec, round(sens + spec - 1, 6) AS tss FROM t ORDER BY round(sens + spec - 1, 12) DESC, threshold LIMIT 1")
def tss_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the largest true skill."""
    return rounded(D.best_threshold(scored(spark, sf_dir), "s", F.col("quality") == 1))


_BOYCE = f"""
WITH {_SCORED}, w AS (SELECT i AS w, i * (0.9::DOUBLE / 99) AS lo FROM range(0, 100) t(i)), n AS (SELECT count(*) AS ne, count(*) FILTER (quality = 1) AS np FROM scored),
f AS (SELECT w, round(count(*) FILTER (quality = 1) / count(*) * max(ne) / max(np), 12) AS f FROM w JOIN scored ON s >= lo AND s <= lo + 0.1::DOUBLE, n GROUP BY w),
r AS (SELECT rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS rf, rank() OVER (ORDER BY w) AS rw FROM f) SELECT round(corr(rf, rw), 6) AS boyce FROM r"""


@query(_BOYCE)
def boyce_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous Boyce index."""
    return rounded(D.boyce(scored(spark, sf_dir), "s", F.col("quality") == 1))


@query(f"WITH {_SCORED} SELECT doc_id, round((SELECT count(*) FROM scored r WHERE r.quality = 1 AND r.s <= q.s) / (SELECT count(*) FROM scored WHERE quality = 1), 6) AS percentile FROM scored q")
def percentile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as percentiles of reference scores."""
    s = scored(spark, sf_dir)
    return rounded(D.percentile_of(s, s.where("quality = 1"), "s").select("doc_id", "percentile"))


_MESS = """
WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, p_retailprice AS b FROM part), r AS (SELECT * FROM p WHERE a > 5 AND b < 1500), e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, count(*) AS n FROM r),
f AS (SELECT p.k, p.a, p.b, la, ha, lb, hb, (SELECT count(*) FROM r WHERE r.a <= p.a) / n * 100 AS fa, (SELECT count(*) FROM r WHERE r.b <= p.b) / n * 100 AS fb FROM p, e),
s AS (SELECT k, CASE WHEN a < la THEN (a - la) / (ha - la) * 100 WHEN a > ha THEN (ha - a) / (ha - la) * 100 WHEN fa <= 50 THEN 2 * fa ELSE 2 * (100 - fa) END AS sa, CASE WHEN b < lb THEN (b - lb) / (hb - lb) * 100 WHEN b > hb THEN (hb - b) / (hb - lb) * 100 WHEN fb <= 50 THEN 2 * fb ELSE 2 * (100 - fb) END AS sb FROM f)
SELECT k, round(least(sa, sb), 6) AS mess, CASE WHEN sa <= sb THEN 'a' ELSE 'b' END AS worst FROM s"""


@query(_MESS)
def mess_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to a reference climate and its worst predictor."""
    p = X.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(D.similarity(p, p.where("a > 5 and b < 1500"), ["a", "b"], "k"))


@query("WITH q AS (SELECT l_partkey % 200 AS cell, l_suppkey % 3 AS period, l_linenumber AS model, CAST(l_quantity * 2 AS INT) AS code, l_tax > 0.06::DOUBLE AS novel FROM lineitem) SELECT cell, period, CAST(round_even(median(code), 0) AS INT) AS code, CAST(round_even(15.0::DOUBLE * count(*) FILTER (code >= 44) / count(*), 0) AS INT) AS agreement, count(*) FILTER (novel) >= greatest(1, ceil(count(*) * 0.5::DOUBLE)) AS novel FROM q GROUP BY 1, 2")
def model_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median class, agreement and novelty over models."""
    q = X.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("cell"), (F.col("l_suppkey") % 3).alias("period"), (F.col("l_quantity") * 2).cast("int").alias("code"), F.col("l_tax").alias("tax"))
    return D.model_vote(q, ["cell", "period"], "code", F.col("tax") > 0.06)


_REACH = f"""
WITH {X.CELLS_SQL}, a AS (SELECT DISTINCT grid_row // 4 AS r, grid_col // 4 AS c FROM cells WHERE now), b AS (SELECT DISTINCT grid_row // 4 AS r, grid_col // 4 AS c FROM cells WHERE later)
SELECT 'unlimited' AS mode, count(*) AS n FROM b UNION ALL SELECT 'none', count(*) FROM b SEMI JOIN a USING (r, c) UNION ALL SELECT 'limited', count(*) FROM b WHERE EXISTS (SELECT 1 FROM a WHERE abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2)"""


@query(_REACH)
def dispersal_limited_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later range under unlimited, no and limited dispersal."""
    coarse = lambda state: X.cells(spark, sf_dir).where(state).select(F.floor(F.col("grid_row") / 4).cast("int").alias("grid_row"), F.floor(F.col("grid_col") / 4).cast("int").alias("grid_col")).distinct()
    now, later = coarse("now"), coarse("later")
    reach = S.dilate(now, 2)
    modes = [("unlimited", later), ("none", later.join(now, ["grid_row", "grid_col"], "left_semi")), ("limited", later.join(reach, ["grid_row", "grid_col"], "left_semi"))]
    out = [df.agg(F.lit(name).alias("mode"), F.count("*").alias("n")) for name, df in modes]
    return out[0].unionByName(out[1]).unionByName(out[2])


def presence_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: predictors a, b, c, positions in km, presence where a hidden niche says so."""
    k = F.col("p_partkey")
    p = X.read(spark, sf_dir, "part").select(k.alias("cell"), ((k * 7919 % 1000) / 1000).alias("a"), ((k * 104729 % 997) / 997).alias("b"), ((k * 31 % 911) / 911 * 0.2 + (k * 7919 % 1000) / 1250).alias("c"), (k % 40 * 25.0).alias("x"), (k % 37 * 25.0).alias("y"))
    niche = C.gauss_curve(F.col("a"), 0.6, 0.15) * C.rising_curve(F.col("b"), 0.4, 0.08)
    return p.withColumn("niche", niche).withColumn("present", (F.col("niche") > (F.col("cell") * 48271 % 1009) / 1009).cast("int"))


@query()
def spearman_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors left after pruning by rank correlation."""
    limits = config()["fit"]
    names = ["a", "b", "c"]
    told = D.prune_correlated(presence_background(spark, sf_dir), names, limits["max_correlation"], limits["max_predictors"])
    return spark.createDataFrame(told.to_records(index=False).tolist(), "predictor string, kept boolean, instead string")


@query()
def block_fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and presences of spatial folds."""
    f = D.block_folds(presence_background(spark, sf_dir), "x", "y", 200.0, F.col("present") == 1)
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("present").alias("presences"))


@query()
def fit_gbt_presence_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated skill of boosted trees in spatial blocks, on a bounded training sample."""
    sample = D.training_sample(presence_background(spark, sf_dir), "present", "cell", config()["fit"]["max_presences"])
    f = D.block_folds(sample, "x", "y", 200.0, F.col("present") == 1, folds=3)
    cv = D.boosted_folds(f, ["a", "b", "c"], "present", "fold", "cell")
    return rounded(D.auc(cv, "raw", F.col("present") == 1, ["fold"]), 4)


@query()
def model_family_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated skill of the other models in spatial blocks."""
    folded = D.block_folds(presence_background(spark, sf_dir), "x", "y", 200.0, F.col("present") == 1, folds=2)
    train = D.training_sample(folded, "present", "cell", config()["fit"]["max_presences"])
    out = None
    for name in ("rf", "glm", "gam", "maxent"):
        part = D.auc(D.cross_validated(folded, name, ["a", "b"], "present", "fold", train=train), "raw", F.col("present") == 1).select(F.lit(name).alias("model"), "auc")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


@query()
def hindcast_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on window 1, blocked cross-fit, both windows scored: neither the scored block nor window 2 is seen."""
    p = D.block_folds(presence_background(spark, sf_dir), "x", "y", 200.0, F.col("present") == 1, folds=3)
    shifted = C.gauss_curve(F.col("a"), 0.6, 0.15) * C.rising_curve(F.col("b"), 0.4, 0.08)
    later = p.withColumn("a", F.col("a") + 0.1).withColumn("niche", shifted).withColumn("present", (F.col("niche") > (F.col("cell") * 48271 % 1009) / 1009).cast("int"))
    windows = p.withColumn("window", F.lit(1)).unionByName(later.withColumn("window", F.lit(2)))
    train = D.training_sample(p, "present", "cell", config()["fit"]["max_presences"])
    scored = D.cross_validated(windows, "glm", ["a", "b"], "present", "fold", train=train)
    return rounded(D.auc(scored, "raw", F.col("present") == 1, ["window"]), 3)


@query()
def production_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned predictors, a bounded sample, cross-validated skill, the out-of-fold threshold, and the fit on all of it.

    The threshold is the fifth percentile of the out-of-fold scores of presences; share is the cells that the fit puts above it.
    """
    limits = config()["fit"]
    p = presence_background(spark, sf_dir)
    told = D.prune_correlated(p, ["a", "b", "c"], limits["max_correlation"], limits["max_predictors"])
    features = told.predictor[told.kept].tolist()
    folded = D.block_folds(p, "x", "y", 200.0, F.col("present") == 1, folds=2)
    train = D.training_sample(folded, "present", "cell", limits["max_presences"])
    out = None
    for name in ("glm", "gam"):
        held = D.cross_validated(train, name, features, "present", "fold")
        bar = held.where("present = 1").agg(F.percentile("raw", F.lit(0.05)).alias("threshold"), F.count("*").alias("presences"))
        every = D.score(D.fit(train, name, features, "present"), p)
        share = every.join(F.broadcast(bar)).agg(F.avg((F.col("raw") >= F.col("threshold")).cast("double")).alias("share"), F.first("threshold").alias("threshold"), F.first("presences").alias("presences"))
        part = share.join(F.broadcast(D.auc(held, "raw", F.col("present") == 1))).select(F.lit(name).alias("model"), "presences", "threshold", "auc", "share")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


@query()
def projection_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit projected over shifted climates: votes of models, then the change of the range."""
    p = presence_background(spark, sf_dir)
    model = D.fit(D.training_sample(p, "present", "cell", config()["fit"]["max_presences"]), "glm", ["a", "b"], "present")
    future = p.withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("a0", F.col("a")).withColumn("a", F.col("a") + F.col("model") * 0.03)
    now = D.score(model, p).select("cell", "y", "x", C.quantised(F.col("raw"), F.lit(0.5)).alias("q"))
    later = D.outside(D.score(model, future), p, ["a", "b"]).withColumn("q", C.quantised(F.col("raw"), F.lit(0.5)))
    vote = D.model_vote(later, ["cell"], "q", F.col("novel"))
    cells = now.join(vote, "cell").select("cell", (F.col("y") / 25).alias("lat"), (F.col("x") / 25).alias("lon"), F.lit(1.0).alias("km2"), (F.col("q") >= 44).alias("now"), (F.col("code") >= 44).alias("later"), F.lit("one").alias("species"))
    return rounded(R.change_summary(cells, ["species"]), 3)


@query()
def weighted_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background drawn in proportion to effort with a uniform floor."""
    c = X.cells(spark, sf_dir).select("cell_id", "score")
    return D.weighted_draw(c, "score", 200, 0.05, "cell_id")


@query("WITH s AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1) SELECT name, n FROM s")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes to be packed into downloads."""
    return X.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@query()
def download_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit-decreasing batches of groups."""
    sizes = [(r.name, r.n) for r in group_sizes(spark, sf_dir).collect()]
    return spark.createDataFrame(D.first_fit(sizes, max(1, max(n for _, n in sizes) * 3)), "name string, batch int")


@query()
def place_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy new places: the largest of each country, spaced."""
    e = config()["expansion"]
    p = X.places(spark, sf_dir)
    ranked = O.first_by(p.withColumn("cell", G.cell_row(F.col("lat"), 1) * 360 + G.cell_col(F.col("lon"), 1)), ["country", "cell"], F.col("pop").desc(), F.col("label"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pop", "label"], ascending=[False, True])
        a, b = np.radians(group.lat.to_numpy()), np.radians(group.lon.to_numpy())
        xyz = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)
        limit, taken = 2 * np.sin(e["spacing_km"] / EARTH / 2), []
        for i in range(len(group)):
            if len(taken) < e["per_country"] and (not taken or np.linalg.norm(xyz[taken] - xyz[i], axis=1).min() >= limit):
                taken.append(i)
        return group.iloc[taken][["country", "place_id", "pop"]]

    return ranked.groupBy("country").applyInPandas(pick, "country int, place_id long, pop long")


_PATCH = f"""
WITH RECURSIVE {X.CELLS_SQL}, m AS (SELECT DISTINCT CAST(grid_row // 20 AS INT) AS r, CAST(grid_col // 20 AS INT) AS c FROM cells WHERE score < 0.35::DOUBLE), start AS (SELECT r, c FROM m ORDER BY r, c LIMIT 1),
p(r, c) AS (SELECT r, c FROM start UNION SELECT m.r, m.c FROM p JOIN m ON abs(m.r - p.r) + abs(m.c - p.c) = 1) SELECT r AS grid_row, c AS grid_col FROM p"""


@query(_PATCH)
def connected_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch of a mask that holds its first cell (Q5)."""
    from ..operators.graph import patches

    m = X.cells(spark, sf_dir).where("score < 0.35").select(F.floor(F.col("grid_row") / 20).cast("int").alias("grid_row"), F.floor(F.col("grid_col") / 20).cast("int").alias("grid_col")).distinct()
    labelled = patches(m)
    first = labelled.agg(F.min(F.struct("grid_row", "grid_col", "patch")).alias("s")).select(F.col("s.patch").alias("patch"))
    return labelled.join(F.broadcast(first), "patch").select("grid_row", "grid_col")
