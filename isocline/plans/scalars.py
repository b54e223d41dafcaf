"""Queries over the climate and geography expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import climate as C
from ..functions import geo as G
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles of a result rounded, so that engines agree on them."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


EARTH = G.EARTH_KM
HAVERSINE = f"2 * {EARTH}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({{b}}lat - {{a}}lat) / 2), 2) + cos(radians({{a}}lat)) * cos(radians({{b}}lat)) * pow(sin(radians({{b}}lon - {{a}}lon) / 2), 2))))"
PHI = "CASE WHEN ({z}) >= 0 THEN 1 - {t} ELSE {t} END"


def phi(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    tail = f"(0.3989422804014327::DOUBLE * exp(-({z}) * ({z}) / 2) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"
    return PHI.format(z=z, t=tail)


def listed(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


DAYS = listed(C.DAYS)
ES = "(0.61094::DOUBLE * exp(17.625::DOUBLE * ({t}) / (({t}) + 243.04::DOUBLE)))"


@query(f"WITH {X.PLACES_SQL} SELECT place_id, round({HAVERSINE.format(a='', b='')}, 6) AS zero, round(2 * {EARTH}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(52.5::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.5::DOUBLE)) * pow(sin(radians(13.4::DOUBLE - lon) / 2), 2)))), 6) AS km, round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z, round((degrees(atan2(sin(radians(13.4::DOUBLE - lon)) * cos(radians(52.5::DOUBLE)), cos(radians(lat)) * sin(radians(52.5::DOUBLE)) - sin(radians(lat)) * cos(radians(52.5::DOUBLE)) * cos(radians(13.4::DOUBLE - lon)))) + 360) % 360, 6) AS bearing FROM places")
def haversine_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing to a fixed point, and unit vectors."""
    p = X.places(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    x, y, z = G.unit_xyz(lat, lon)
    return rounded(p.select("place_id", G.haversine_km(lat, lon, lat, lon).alias("zero"), G.haversine_km(lat, lon, F.lit(52.5), F.lit(13.4)).alias("km"), x.alias("x"), y.alias("y"), z.alias("z"), G.bearing(lat, lon, F.lit(52.5), F.lit(13.4)).alias("bearing")))


@query(f"WITH {X.CLIMATE_SQL} SELECT place_id, CAST(m AS INT) AS m, round({ES.format(t='tmax')}, 6) AS es, round(243.04::DOUBLE * ln(greatest(vap, 0.0001::DOUBLE) / 0.61094::DOUBLE) / (17.625::DOUBLE - ln(greatest(vap, 0.0001::DOUBLE) / 0.61094::DOUBLE)), 6) AS dew FROM climate")
def vapour_pressure_dewpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation vapour pressure and dewpoint."""
    c = X.climate_long(spark, sf_dir)
    return rounded(c.select("place_id", "m", C.sat_vap(F.col("tmax")).alias("es"), C.dewpoint(F.col("vap")).alias("dew")))


_PET = f"""
WITH {X.CLIMATE_SQL}, sun AS (SELECT *, {listed(C.radiation_factors(k)[0] for k in range(12))}[m] AS near, {listed(C.radiation_factors(k)[1] for k in range(12))}[m] AS tilt, {DAYS}[m] AS days FROM climate),
angle AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -tan(radians(lat)) * tan(tilt)))) AS w FROM sun),
pet AS (SELECT place_id, m, 0.0023::DOUBLE * greatest((24 * 60 / pi()) * 0.0820::DOUBLE * near * (w * sin(radians(lat)) * sin(tilt) + cos(radians(lat)) * cos(tilt) * sin(w)), 0.0::DOUBLE) / 2.45::DOUBLE * greatest((tmax + tmin) / 2 + 17.8::DOUBLE, 0.0::DOUBLE) * sqrt(greatest(tmax - tmin, 0.1::DOUBLE)) * days AS pet FROM angle)
SELECT place_id, round(sum(pet), 4) AS pet_year, round(max(pet), 4) AS pet_max FROM pet GROUP BY place_id"""


@query(_PET)
def hargreaves_pet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential evapotranspiration by month, summed (P5)."""
    c = X.climate(spark, sf_dir).withColumn("pet", C.hargreaves_pet(F.col("tmax"), F.col("tmin"), F.col("lat")))
    return rounded(c.select("place_id", C.total(F.col("pet")).alias("pet_year"), F.array_max("pet").alias("pet_max")), 4)


_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 0 WHEN m <= 5 THEN 1 WHEN m <= 8 THEN 2 ELSE 3 END"
_SEASONAL = f"""
WITH {X.CLIMATE_SQL}, s AS (SELECT place_id, {_SEASON} AS season, avg(tmax) AS tx, avg(tmin) AS tn, sum(ppt) AS p, avg(vap) AS v FROM climate GROUP BY 1, 2),
d AS (SELECT *, ln(greatest(v, 0.0001::DOUBLE) / 0.61094::DOUBLE) AS l FROM s)
SELECT place_id, CAST(season AS INT) AS season, round(tx, 6) AS tmax, round(tn, 6) AS tmin, round(p, 6) AS ppt, round(243.04::DOUBLE * l / (17.625::DOUBLE - l), 6) AS dew, round(ln(greatest(p, 0) + 1), 6) AS log_ppt, CAST(round_even(tx * 100, 0) AS SMALLINT) AS code FROM d"""


@query(_SEASONAL)
def seasonal_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal vectors of normals, in metric space and encoded."""
    c = X.climate(spark, sf_dir)
    v = c.select("place_id", C.seasonal(F.col("tmax"), F.col("tmin"), F.col("ppt"), F.col("vap")).alias("v"))
    v = v.select("place_id", "v", C.metric_space(F.col("v")).alias("w"), C.encoded(F.col("v")).alias("e"))
    s = v.select("place_id", "v", "w", "e", F.explode(F.array(*map(F.lit, range(4)))).alias("season"))
    at = lambda a, k: F.get(F.col(a), F.col("season") + k)
    return rounded(s.select("place_id", "season", at("v", 0).alias("tmax"), at("v", 4).alias("tmin"), at("v", 8).alias("ppt"), at("v", 12).alias("dew"), at("w", 8).alias("log_ppt"), at("e", 0).alias("code")))


@query(f"WITH {X.CLIMATE_SQL} SELECT place_id, CAST(m AS INT) AS m, round(greatest(0.2::DOUBLE, least(5.0::DOUBLE, CASE WHEN ppt > 0 THEN (ppt * rp) / ppt ELSE 1 END)), 6) AS rain, round(greatest(0.5::DOUBLE, least(3.0::DOUBLE, rv)), 6) AS vapour, round(greatest(0.01::DOUBLE, least(100.0::DOUBLE, CASE WHEN ppt > 0.5::DOUBLE THEN (ppt * rp) / ppt ELSE 1 END)), 6) AS packed FROM climate WHERE rv IS NOT NULL")
def delta_ratio_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change ratios with dry months and clips."""
    c = X.climate_long(spark, sf_dir, changes=True).where("rv is not null")
    wet = F.col("ppt") * F.col("rp")
    return rounded(c.select("place_id", "m", C.ratio(wet, F.col("ppt"), 0.2, 5.0).alias("rain"), C.clip(F.col("rv"), 0.5, 3.0).alias("vapour"), C.ratio(wet, F.col("ppt"), 0.01, 100.0, dry=0.5).alias("packed")))


_HALF = ES.format(t="(tmax + tmin) / 2 + (dtx + dtn) / 2") + " / " + ES.format(t="(tmax + tmin) / 2")


@query(f"WITH {X.CLIMATE_SQL} SELECT place_id, CAST(m AS INT) AS m, round(tmax + dtx, 6) AS tx, round(least(tmin + dtn, tmax + dtx - 0.1::DOUBLE), 6) AS tn, round(ppt * rp, 6) AS p, round(vap * coalesce(rv, {_HALF}), 6) AS v FROM climate")
def constant_rh_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projected month; humidity held where a model has none."""
    c = X.climate_long(spark, sf_dir, changes=True)
    tx, tn, p, v = C.apply_change(*[F.col(n) for n in ("tmax", "tmin", "ppt", "vap", "dtx", "dtn", "rp", "rv")])
    return rounded(c.select("place_id", "m", tx.alias("tx"), tn.alias("tn"), p.alias("p"), v.alias("v")))


_BLEND = f"""
WITH {X.CLIMATE_SQL}, fine AS (SELECT place_id, m, CASE WHEN (place_id + m) % 97 = 0 THEN NULL ELSE dtx + 1 END AS fx, CASE WHEN place_id % 5 = 1 THEN NULL ELSE rv END AS fv, dtx, rv FROM climate),
whole AS (SELECT place_id, count(fx) = 12 AS has_t, count(fv) = 12 AS has_v FROM fine GROUP BY 1)
SELECT place_id, CAST(m AS INT) AS m, round(CASE WHEN has_t THEN fx ELSE dtx END, 6) AS dtx, round(CASE WHEN has_v THEN fv ELSE rv END, 6) AS rv FROM fine JOIN whole USING (place_id)"""


@query(_BLEND)
def delta_blend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finer source's change where it has all twelve months, humidity on its own."""
    c = X.climate(spark, sf_dir, changes=True)
    fine = C.each(F.col("dtx"))(lambda i, x: F.when((F.col("place_id") + i + 1) % 97 != 0, x + 1))
    fine_v = C.each(F.col("rv"))(lambda i, x: F.when(F.col("place_id") % 5 != 1, x))
    c = c.withColumn("fx", fine).withColumn("fv", fine_v)
    out = c.select("place_id", F.when(C.complete(F.col("fx")), F.col("fx")).otherwise(F.col("dtx")).alias("a"), F.when(C.complete(F.col("fv")), F.col("fv")).otherwise(F.col("rv")).alias("b"))
    rows = out.select("place_id", "b", F.posexplode("a").alias("i", "dtx"))
    return rounded(rows.select("place_id", (F.col("i") + 1).alias("m"), "dtx", F.get("b", F.col("i")).alias("rv")))


@query(f"WITH {X.CLIMATE_SQL} SELECT place_id, CAST(m AS INT) AS m, round(pet * greatest(0.5::DOUBLE, least(3.0::DOUBLE, (hf + 1) / (hb + 1))), 6) AS pet, round(srad * greatest(0.8::DOUBLE, least(1.25::DOUBLE, (hf + 5) / (hb + 5))), 6) AS srad FROM (SELECT *, ppt + 3 AS pet, vap * 100 AS srad, ppt * rp AS hf, ppt AS hb FROM climate)")
def extras_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional measures carried by clipped ratios (P10)."""
    c = X.climate_long(spark, sf_dir, changes=True)
    after, before = F.col("ppt") * F.col("rp"), F.col("ppt")
    return rounded(c.select("place_id", "m", ((before + 3) * C.clip((after + 1) / (before + 1), 0.5, 3.0)).alias("pet"), (F.col("vap") * 100 * C.clip((after + 5) / (before + 5), 0.8, 1.25)).alias("srad")))


_ESH = "(6.112::DOUBLE * exp(17.62::DOUBLE * ({t}) / (243.12::DOUBLE + ({t}))))"
_RH = f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, (place_id * m % 100) * {_ESH.format(t='(tmax + tmin) / 2')} / {_ESH.format(t='tmax')}))"


@query(f"WITH {X.CLIMATE_SQL}, r AS (SELECT place_id, m, {_RH} AS rh, greatest(-20.0::DOUBLE, least(50.0::DOUBLE, tmax)) AS t, greatest(5.0::DOUBLE, least(99.0::DOUBLE, {_RH})) AS h FROM climate) SELECT place_id, CAST(m AS INT) AS m, round(rh, 6) AS rh, round(t * atan(0.151977::DOUBLE * sqrt(h + 8.313659::DOUBLE)) + atan(t + h) - atan(h - 1.676331::DOUBLE) + 0.00391838::DOUBLE * pow(h, 1.5::DOUBLE) * atan(0.023101::DOUBLE * h) - 4.686035::DOUBLE, 6) AS wb FROM r")
def wet_bulb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative humidity at the day's high, and the wet-bulb temperature."""
    c = X.climate_long(spark, sf_dir)
    rh = C.rh_at_tmax((F.col("place_id") * F.col("m") % 100).cast("double"), (F.col("tmax") + F.col("tmin")) / 2, F.col("tmax"))
    return rounded(c.select("place_id", "m", rh.alias("rh"), C.wet_bulb(F.col("tmax"), rh).alias("wb")))


_KOPPEN = f"""
WITH {X.CLIMATE_SQL}, c AS (SELECT place_id, m, (tmax + tmin) / 2 AS t, greatest(ppt, 0) AS p FROM climate),
y AS (SELECT place_id, avg(t) AS mat, sum(p) AS rain, min(t) AS cold, max(t) AS hot, count(*) FILTER (t > 10) AS mild, min(p) AS dry, avg(t) FILTER (m BETWEEN 4 AND 9) >= avg(t) FILTER (m NOT BETWEEN 4 AND 9) AS north,
  sum(p) FILTER (m BETWEEN 4 AND 9) AS sa, min(p) FILTER (m BETWEEN 4 AND 9) AS na, max(p) FILTER (m BETWEEN 4 AND 9) AS xa, sum(p) FILTER (m NOT BETWEEN 4 AND 9) AS so, min(p) FILTER (m NOT BETWEEN 4 AND 9) AS no, max(p) FILTER (m NOT BETWEEN 4 AND 9) AS xo FROM c GROUP BY place_id),
h AS (SELECT *, CASE WHEN north THEN sa ELSE so END AS ss, CASE WHEN north THEN na ELSE no END AS sn, CASE WHEN north THEN xa ELSE xo END AS sx, CASE WHEN north THEN so ELSE sa END AS ws, CASE WHEN north THEN no ELSE na END AS wn, CASE WHEN north THEN xo ELSE xa END AS wx FROM y),
k AS (SELECT *, CASE WHEN ws >= 0.7::DOUBLE * rain THEN 2 * mat WHEN ss >= 0.7::DOUBLE * rain THEN 2 * mat + 28 ELSE 2 * mat + 14 END AS arid FROM h)
SELECT place_id, CASE WHEN hot < 10 THEN CASE WHEN hot > 0 THEN 'ET' ELSE 'EF' END
  WHEN rain < 10 * arid THEN CASE WHEN rain < 5 * arid THEN 'BW' ELSE 'BS' END || CASE WHEN mat >= 18 THEN 'h' ELSE 'k' END
  WHEN cold >= 18 THEN CASE WHEN dry >= 60 THEN 'Af' WHEN dry >= 100 - rain / 25 THEN 'Am' ELSE 'Aw' END
  ELSE CASE WHEN cold > 0 THEN 'C' ELSE 'D' END || CASE WHEN sn < 40 AND sn < wx / 3 THEN 's' WHEN wn < sx / 10 THEN 'w' ELSE 'f' END || CASE WHEN hot >= 22 THEN 'a' WHEN mild >= 4 THEN 'b' WHEN cold <= 0 AND cold < -38 THEN 'd' ELSE 'c' END END AS kg FROM k"""


@query(_KOPPEN)
def koppen_like_case_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate classes."""
    return X.climate(spark, sf_dir).select("place_id", C.koppen(F.col("tmax"), F.col("tmin"), F.col("ppt")).alias("kg"))


_ZONE = f"""
WITH {X.CLIMATE_SQL}, e AS (SELECT place_id, -10.47579::DOUBLE + 1.38707::DOUBLE * min(tmin) + 0.06059::DOUBLE * (max(tmax) - min(tmin)) - 0.2836::DOUBLE * ln(1 + sum(greatest(ppt, 0))) AS emt FROM climate GROUP BY place_id),
z AS (SELECT place_id, emt, CAST(least(greatest(floor((emt * 9 / 5 + 32 + 60) / 5) + 2, 2), 27) AS INT) AS zone FROM e)
SELECT place_id, round(emt, 6) AS emt, zone, CAST(CAST(floor(zone / 2) AS INT) AS VARCHAR) || CASE WHEN zone % 2 = 1 THEN 'b' ELSE 'a' END AS label FROM z"""


@query(_ZONE)
def hardiness_zone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extreme minimum and hardiness half zone."""
    c = X.climate(spark, sf_dir).select("place_id", C.extreme_min(F.col("tmax"), F.col("tmin"), F.col("ppt")).alias("emt"))
    z = c.withColumn("zone", C.zone_index(F.col("emt")))
    return rounded(z.withColumn("label", C.zone_label(F.col("zone"))))


@query(f"WITH {X.CLIMATE_SQL} SELECT place_id, round(sum({DAYS}[m] * ({phi('((tmin - 4.5625::DOUBLE) / 7.3276::DOUBLE)')})), 5) AS ffp, round(sum({DAYS}[m] * ({phi('((0.0::DOUBLE - tmin) / 3.0::DOUBLE)')})), 5) AS frost FROM climate GROUP BY place_id")
def frost_free_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frost-free period and frost days."""
    return rounded(X.climate(spark, sf_dir).select("place_id", C.frost_free_days(F.col("tmin")).alias("ffp"), C.frost_days(F.col("tmin")).alias("frost")), 5)


_BIO = f"""
WITH {X.CLIMATE_SQL}, q AS (SELECT a.place_id, a.m, sum(b.ppt) AS q FROM climate a JOIN climate b ON a.place_id = b.place_id AND (b.m - a.m + 12) % 12 < 3 GROUP BY 1, 2), w AS (SELECT place_id, min(q) AS bio17 FROM q GROUP BY 1)
SELECT place_id, round(avg((tmax + tmin) / 2), 6) AS bio1, round(stddev_samp((tmax + tmin) / 2) * 100, 6) AS bio4, round(max(tmax), 6) AS bio5, round(min(tmin), 6) AS bio6, round(sum(ppt), 6) AS bio12, round(CASE WHEN avg(ppt) > 0 THEN stddev_samp(ppt) / avg(ppt) * 100 ELSE 0 END, 6) AS bio15, round(max(bio17), 6) AS bio17 FROM climate JOIN w USING (place_id) GROUP BY place_id"""


@query(_BIO)
def bioclim_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven bioclimatic variables with wrapped quarters."""
    b = C.bioclim(F.col("tmax"), F.col("tmin"), F.col("ppt"))
    return rounded(X.climate(spark, sf_dir).select("place_id", *[c.alias(n) for n, c in b.items()]))


_DERIVED = f"""
WITH {X.CLIMATE_SQL}, s AS (SELECT place_id, {_SEASON} AS season, avg(tmax) AS tx, avg(tmin) AS tn, sum(ppt) AS p, avg(vap) AS v FROM climate GROUP BY 1, 2),
d AS (SELECT *, (tx + tn) / 2 AS tm, 243.04::DOUBLE * ln(greatest(v, 0.0001::DOUBLE) / 0.61094::DOUBLE) / (17.625::DOUBLE - ln(greatest(v, 0.0001::DOUBLE) / 0.61094::DOUBLE)) AS dw FROM s),
e AS (SELECT *, greatest({ES.format(t='tm')} - {ES.format(t='dw')}, 0) AS vpd FROM d)
SELECT place_id, round(avg(tm), 5) AS mat, round(min(tn), 5) AS tcold, round(max(tx), 5) AS twarm, round(max(tm) - min(tm), 5) AS tseas, round(ln(1 + sum(p)), 5) AS lp, round(ln(1 + min(p)), 5) AS lpdry, round(ln(1 + max(p)), 5) AS lpwet, round(avg(vpd), 5) AS vpd, round(max(vpd), 5) AS vpdmax, round(ln(1 + sum(p)) - ln(avg(vpd) * 1000 + 1), 5) AS balance FROM e GROUP BY place_id"""


@query(_DERIVED)
def derived_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten predictors from the sixteen seasonal values."""
    v = X.climate(spark, sf_dir).select("place_id", C.seasonal(F.col("tmax"), F.col("tmin"), F.col("ppt"), F.col("vap")).alias("v"))
    part = lambda k: F.slice("v", k + 1, 4)
    v = v.select("place_id", part(0).alias("tx"), part(4).alias("tn"), part(8).alias("p"), part(12).alias("dw")).withColumn("tm", F.zip_with("tx", "tn", lambda a, b: (a + b) / 2))
    v = v.withColumn("vpd", F.zip_with("tm", "dw", lambda t, d: F.greatest(C.sat_vap(t) - C.sat_vap(d), F.lit(0.0))))
    rain = C.total(F.col("p"))
    return rounded(v.select("place_id", C.mean(F.col("tm")).alias("mat"), F.array_min("tn").alias("tcold"), F.array_max("tx").alias("twarm"), (F.array_max("tm") - F.array_min("tm")).alias("tseas"), F.log1p(rain).alias("lp"), F.log1p(F.array_min("p")).alias("lpdry"), F.log1p(F.array_max("p")).alias("lpwet"), C.mean(F.col("vpd")).alias("vpd"), F.array_max("vpd").alias("vpdmax"), (F.log1p(rain) - F.log(C.mean(F.col("vpd")) * 1000 + 1)).alias("balance")), 5)


@query(f"WITH {X.CELLS_SQL} SELECT cell_id, round(exp(-0.5::DOUBLE * pow((score - 0.5::DOUBLE) / 0.2::DOUBLE, 2)), 6) AS bell, round(1 / (1 + exp(-(score - 0.3::DOUBLE) / 0.1::DOUBLE)), 6) AS rising, round(1 / (1 + exp((score - 0.7::DOUBLE) / 0.1::DOUBLE)), 6) AS falling FROM cells")
def niche_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response curves of virtual species."""
    s = F.col("score")
    return rounded(X.cells(spark, sf_dir).select("cell_id", C.gauss_curve(s, 0.5, 0.2).alias("bell"), C.rising_curve(s, 0.3, 0.1).alias("rising"), C.falling_curve(s, 0.7, 0.1).alias("falling")))


_QUANT = f"""
WITH {X.CELLS_SQL}, q AS (SELECT cell_id, CAST(CASE WHEN score >= 0.37::DOUBLE THEN least(44 + floor((score - 0.37::DOUBLE) / (1 - 0.37::DOUBLE) * 84), 127) ELSE least(floor(score / 0.37::DOUBLE * 44), 43) END AS INT) AS code, now FROM cells),
r AS (SELECT cell_id, code, CASE WHEN now THEN code | 128 ELSE code END AS reach FROM q)
SELECT cell_id, code, CAST((CASE WHEN (reach & 127) < 44 THEN 0 ELSE 1 + least(2, floor(((reach & 127) - 44) * 3 / 84)) END)::INT | (reach & 128) AS INT) AS lite FROM r"""


@query(_QUANT)
def quantise_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-bit suitability and its classes."""
    q = X.cells(spark, sf_dir).select("cell_id", C.quantised(F.col("score"), F.lit(0.37)).alias("code"), "now")
    reach = F.when(F.col("now"), F.col("code").bitwiseOR(F.lit(128))).otherwise(F.col("code"))
    return q.select("cell_id", "code", C.lite_class(reach).alias("lite"))


_CELL = f"""
WITH {X.PLACES_SQL}, c AS (SELECT *, CAST(least(greatest(floor((90 - lat) * 24), 0), 4319) AS INT) AS r, CAST((floor((lon + 180) * 24) % 8640 + 8640) % 8640 AS INT) AS k FROM places)
SELECT place_id, r AS grid_row, k AS grid_col, CAST(least(floor((lat + 90) / 2.5::DOUBLE), 71) * 144 + least(floor((lon + 180) / 2.5::DOUBLE), 143) AS BIGINT) AS south,
  round({EARTH ** 2 * math.radians(1 / 24)!r}::DOUBLE * (sin(radians(90 - r / 24::DOUBLE)) - sin(radians(90 - (r + 1) / 24::DOUBLE))), 6) AS km2, round(90 - (r + 0.5::DOUBLE) / 24, 6) AS mid_lat, round(-180 + (k + 0.5::DOUBLE) / 24, 6) AS mid_lon,
  CAST(round_even((lat + 90) / 0.25::DOUBLE, 0) AS INT) AS at_row, CAST(CAST(round_even((lon + 180) / 0.25::DOUBLE, 0) AS INT) % 1440 AS INT) AS at_col FROM c"""


@query(_CELL)
def cell_index_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the north-origin and south-origin grids, their areas, nearest grid points."""
    p, lat, lon = X.places(spark, sf_dir), F.col("lat"), F.col("lon")
    p = p.withColumn("grid_row", G.cell_row(lat)).withColumn("grid_col", G.cell_col(lon))
    return rounded(p.select("place_id", "grid_row", "grid_col", G.south_cell(lat, lon, 2.5).cast("long").alias("south"), G.row_area_km2(F.col("grid_row")).alias("km2"), G.cell_lat(F.col("grid_row")).alias("mid_lat"), G.cell_lon(F.col("grid_col")).alias("mid_lon"), G.nearest_index(lat, -90.0, 0.25).alias("at_row"), G.nearest_index(lon, -180.0, 0.25, wrap=1440).alias("at_col")))


_LAEA = f"""
WITH {X.PLACES_SQL}, a AS (SELECT place_id, lat, lon, radians(lat) AS a, radians(lon + 100) AS d FROM places WHERE lat > -30),
k AS (SELECT *, {EARTH}::DOUBLE * sqrt(2 / (1 + sin(radians(45)) * sin(a) + cos(radians(45)) * cos(a) * cos(d))) AS k FROM a)
SELECT place_id, round(k * cos(a) * sin(d), 4) AS x, round(k * (cos(radians(45)) * sin(a) - sin(radians(45)) * cos(a) * cos(d)), 4) AS y, round(lat, 4) AS lat, round(lon, 4) AS lon FROM k"""


@query(_LAEA)
def equal_area_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-area projection and back."""
    p = X.places(spark, sf_dir).where("lat > -30")
    x, y = G.equal_area_xy(F.col("lat"), F.col("lon"))
    p = p.select("place_id", x.alias("x"), y.alias("y"))
    lat, lon = G.equal_area_latlon(F.col("x"), F.col("y"))
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    return rounded(p.select("place_id", "x", "y", lat.alias("lat"), wrapped.alias("lon")), 4)


_MONTH = """
WITH d AS (SELECT event_id, CAST(event_id % 365 + 1 AS INT) AS day, CAST(CASE event_id % 3 WHEN 0 THEN 365 WHEN 1 THEN 360 ELSE 366 END AS INT) AS length FROM events)
SELECT event_id, CAST(CASE length WHEN 365 THEN month(DATE '2023-01-01' + (day - 1)) WHEN 366 THEN month(DATE '2024-01-01' + (day - 1)) ELSE least(12, floor((day - 1) / 30) + 1) END AS INT) AS m FROM d"""


@query(_MONTH)
def month_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of days in years of three lengths."""
    e = X.read(spark, sf_dir, "events")
    day, length = (F.col("event_id") % 365 + 1).cast("int"), F.when(F.col("event_id") % 3 == 0, 365).when(F.col("event_id") % 3 == 1, 360).otherwise(366)
    return e.select("event_id", C.month_of_day(day, length).cast("int").alias("m"))


@query(f"WITH {X.PLACES_SQL} SELECT place_id, CASE WHEN s < 1 THEN 'excellent' WHEN s < 2 THEN 'good' WHEN s < 4 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN place_id % 11 = 0 THEN NULL WHEN s >= 1 OR (s >= 0.5::DOUBLE AND place_id % 2 = 0) THEN 'high' WHEN s >= 0.5::DOUBLE OR place_id % 2 = 0 THEN 'moderate' ELSE 'ok' END AS flag, round(least((s * 100) % 360, 360 - (s * 100) % 360), 6) AS turn FROM (SELECT place_id, (place_id % 60) / 10::DOUBLE AS s FROM places)")
def sensitivity_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality bands, sensitivity flags and angles."""
    p = X.places(spark, sf_dir).select("place_id", ((F.col("place_id") % 60) / 10.0).alias("s"))
    distance = F.when(F.col("place_id") % 11 != 0, F.col("s"))
    return rounded(p.select("place_id", C.quality_band(F.col("s")).alias("band"), C.sensitivity(distance, F.col("place_id") % 2 == 0).alias("flag"), G.angle_diff(F.col("s") * 100, F.lit(0.0)).alias("turn")))
