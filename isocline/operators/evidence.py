"""Verdicts over species and groups, choices between runs, combinations of sources, matched baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from .occurrence import first_by

# Limits of the hindcast's group checks.
VERDICT = {"direction": 0.7, "alpha": 0.05, "ratio": (0.5, 2.0), "correlation": 0.3, "beat_null": 0.6, "boyce": 0.5}
RANKS = ("ok", "moderate", "high")


def region_of(df: DataFrame, regions: DataFrame, country: str = "country", lat: str = "lat") -> DataFrame:
    """A column `region` from (country, region), unknown ones as Other; the United States south of 23 N are Oceania."""
    side = regions.select(F.col("country").alias("_c"), "region")
    side = F.broadcast(side) if side.count() <= 100_000 else side
    named = df.join(side, F.col(country) == F.col("_c"), "left").drop("_c")
    return named.withColumn("region", F.when((F.col(country) == "US") & (F.col(lat) < 23), F.lit("Oceania")).otherwise(F.coalesce("region", F.lit("Other"))))


def download_group(domain: Column, country: Column, region: Column) -> Column:
    """A country's own group within the first domain, the region's slug elsewhere."""
    own = F.when(country.isin("US", "CA", "MX"), F.lower(country)).otherwise(F.lit("na"))
    return F.when(domain == 0, own).otherwise(F.replace(F.lower(region), F.lit(" "), F.lit("-")))


def place_key(lat: Column, lon: Column) -> Column:
    """Coordinates at four decimals, without a negative zero."""
    four = lambda x: F.when(F.round(x, 4) == 0, F.lit(0.0)).otherwise(F.round(x, 4))
    return F.format_string("%.4f,%.4f", four(lat), four(lon))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def dispersal(group: Column, rates: dict[str, float], default: float, override: Column | None = None) -> Column:
    """Kilometres a decade: the species' own value, else its group's."""
    by_group = F.coalesce(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[group], F.lit(default))
    return by_group if override is None else F.coalesce(F.nanvl(override, F.lit(None).cast("double")), by_group)


def combined_flag(flags: Column, corroborated: bool) -> Column:
    """The worst of the sources' flags, or the second worst where two or more speak; null without any."""
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(RANKS) for x in (n, k)])
    known = F.sort_array(F.transform(F.filter(flags, lambda x: x.isNotNull()), lambda x: rank[x]), asc=False)
    at = F.when(F.lit(corroborated) & (F.size(known) >= 2), 1).otherwise(0)
    return F.get(F.array(*map(F.lit, RANKS)), F.get(known, at))


def outside_share(shares: Column, inside: Column) -> Column:
    """The sum of a text's name:share parts whose names aren't in the array."""
    parts = F.filter(F.split(F.coalesce(shares, F.lit("")), ";"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.split(x, ":")[1].cast("double")
    return F.aggregate(F.filter(parts, lambda x: ~F.array_contains(inside, F.split(x, ":")[0])), F.lit(0.0), lambda s, x: s + value(x))


def matched_footprint(base: Column, point: Column, box: Column) -> Column:
    """A baseline vector moved from its point to a box, rain in logarithms."""
    parts = F.arrays_zip(base.alias("b"), point.alias("p"), box.alias("x"))
    rain = lambda v: F.log(F.greatest(v, F.lit(0.0)) + 1)
    return F.transform(parts, lambda s, i: F.when((i >= 8) & (i < 12), F.exp(rain(s["b"]) + rain(s["x"]) - rain(s["p"])) - 1).otherwise(s["b"] + s["x"] - s["p"]))


def preferred_run(runs: DataFrame) -> DataFrame:
    """One run of each organism: of those that may be published, a tier A run, else by the kind's order of preference.

    runs: organism, is_bird, kind (breeding, rg_all, all), tier, publishable. Birds prefer their breeding season.
    """
    bird = F.when(F.col("kind") == "breeding", 0).when(F.col("kind") == "rg_all", 1).otherwise(2)
    other = F.when(F.col("kind") == "rg_all", 0).when(F.col("kind") == "all", 1).otherwise(2)
    order = F.when(F.col("is_bird"), bird).otherwise(other)
    ready = runs.where(F.col("publishable") & F.col("tier").isin("A", "B"))
    return first_by(ready, ["organism"], F.when(F.col("tier") == "A", 0).otherwise(1), order)


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) for any n: terms away from the mode shrink by known ratios, so that they are added from the first until they no longer count."""
    if n == 0:
        return float("nan")
    if k <= 0 or k > n or p in (0.0, 1.0):
        return float(k <= 0 or (k <= n and p == 1.0))
    upper = k > n * p
    at = k if upper else k - 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1) + at * math.log(p) + (n - at) * math.log1p(-p))
    total = 0.0
    while 0 <= at <= n and term > total * 1e-17:
        total += term
        term *= (n - at) / (at + 1) * p / (1 - p) if upper else at / (n - at + 1) * (1 - p) / p
        at += 1 if upper else -1
    return min(1.0, total) if upper else max(0.0, 1 - total)


def group_verdict(results: DataFrame, by: Sequence[str], need: int) -> DataFrame:
    """by, n, five checks, status: insufficient data, pass or fail.

    results: by, eligible, direction_agree, ratio, correlation, error, error_null, area_sign, beats_null; null is unknown.
    """
    share = lambda c: F.avg(F.col(c).cast("int"))
    g = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("eligible").cast("int")).alias("eligible"), F.sum(F.col("direction_agree").cast("int")).alias("agree"), F.count("direction_agree").alias("known"),
        F.median("ratio").alias("ratio"), F.median("correlation").alias("correlation"), F.median(F.when(F.col("error_null").isNotNull(), F.col("error"))).alias("error"), F.median(F.when(F.col("error").isNotNull(), F.col("error_null"))).alias("error_null"), share("area_sign").alias("area"), share("beats_null").alias("beats"),
    )

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    no = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "direction": no((F.try_divide(F.col("agree"), F.col("known")) >= VERDICT["direction"]) & (F.col("p") < VERDICT["alpha"])),
        "magnitude": no(F.col("ratio").between(*VERDICT["ratio"])),
        "errors": no(F.col("error") < F.col("error_null")),
        "area_change": no((F.col("area") > 0.5) & (F.col("correlation") >= VERDICT["correlation"])),
        "beats": no(F.col("beats") >= VERDICT["beat_null"]),
    }
    out = g.withColumn("p", tail(F.coalesce("agree", F.lit(0)), "known"))
    out = out.select(*by, "n", "eligible", *[c.alias(n) for n, c in checks.items()])
    every = F.lit(True)
    for n in checks:
        every = every & F.col(n)
    return out.withColumn("status", F.when(F.col("eligible") < need, F.lit("insufficient data")).when(every, F.lit("pass")).otherwise(F.lit("fail")))


def species_verdict(df: DataFrame) -> DataFrame:
    """tier and reasons of a species from its group's status and its own checks (null: unknown)."""
    reasons = F.filter(F.array(
        F.when(F.col("status") == "insufficient data", F.lit("too few species")).when(F.col("status") == "fail", F.lit("group failed")),
        F.when(F.col("cv_gate").isNull(), F.lit("no skill")).when(~F.col("cv_gate"), F.lit("skill gate")),
        F.when(~F.col("transfer_ok"), F.lit("transfer")),
        F.when(F.col("boyce2") < VERDICT["boyce"], F.lit("boyce")),
        F.when(~F.coalesce("beats_null", F.lit(False)), F.lit("null model")),
        F.when(~F.col("direction_agree"), F.lit("direction")),
    ), lambda x: x.isNotNull())
    out = df.withColumn("reasons", reasons)
    return out.withColumn("tier", F.when(F.size("reasons") == 0, F.lit("Tier 1")).when(~F.col("cv_gate"), F.lit("Tier 3")).otherwise(F.lit("Tier 2")))


def shrunk_covariance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance shrunk towards a multiple of the identity (Ledoit and Wolf 2004)."""
    n, p = x.shape
    mean = x.mean(axis=0)
    z = x - mean
    s = z.T @ z / n
    mu = np.trace(s) / p
    apart = np.sum((s - mu * np.eye(p)) ** 2) / p
    noise = (np.sum((z**2).T @ (z**2)) / n - np.sum(s**2)) / (n * p)
    share = 0.0 if apart == 0 else min(noise, apart) / apart
    return mean, (1 - share) * s + share * mu * np.eye(p)


def mahalanobis_novelty(df: DataFrame, reference: DataFrame, predictors: Sequence[str], key: str, quantile: float = 0.999, trim: float | None = None, sample: int = 20_000) -> DataFrame:
    """key, distance, sigma, novel: how far rows lie from a reference cloud, fitted on at most `sample` of its rows.

    trim: the share of the nearest reference rows on which the fit is repeated once.
    """
    rows = reference.select(*predictors).dropna().orderBy(F.xxhash64(*predictors)).limit(sample).toPandas().to_numpy(float)
    mean, cov = shrunk_covariance(rows)
    far = lambda x, m, c: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), 0))
    if trim:
        d = far(rows, mean, cov)
        mean, cov = shrunk_covariance(rows[d <= np.quantile(d, trim)])
    cut = float(np.quantile(far(rows, mean, cov), quantile))
    k = len(predictors)
    kind = dict(df.dtypes)[key]

    def run(frames):
        for f in frames:
            d = far(f[list(predictors)].to_numpy(float), mean, cov)
            yield pd.DataFrame({key: f[key], "distance": d, "sigma": [numeric.chi_to_sigma(v, k) if np.isfinite(v) else np.nan for v in d], "novel": d > cut})

    return df.select(key, *predictors).mapInPandas(run, f"{key} {kind}, distance double, sigma double, novel boolean")


def variance_inflation(df: DataFrame, predictors: Sequence[str]) -> list[tuple[str, float]]:
    """Each predictor's variance inflation, from one small correlation matrix."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    r = Correlation.corr(VectorAssembler(inputCols=list(predictors), outputCol="_v", handleInvalid="skip").transform(df).select("_v"), "_v").head()[0].toArray()
    return list(zip(predictors, np.diag(np.linalg.inv(r + 1e-9 * np.eye(len(r)))).tolist(), strict=True))


def random_bearing_error(km: Column, angle: Column) -> Column:
    """The error of a shift of the right length in a direction off by an angle in radians."""
    return 2 * F.abs(km) * F.abs(F.sin(angle / 2))
