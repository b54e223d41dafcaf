"""Range statistics over cells: centroids, edges, gains and losses, agreement, resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import EARTH_KM
from .ordering import weighted_quantiles


def _when(test: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0.0))


def change_summary(cells: DataFrame, by: Sequence[str], now: str = "now", later: str = "later", area: str = "km2") -> DataFrame:
    """Areas, change, centroids, shift, bearing, gain, loss and stable area of two states, in one aggregation."""
    a, b, w = F.col(now), F.col(later), F.col(area)
    x, y, z = geo.unit_xyz(F.col("lat"), F.col("lon"))
    sums = [_when(t, v * w).alias(f"{n}{s}") for s, t in (("0", a), ("1", b)) for n, v in (("x", x), ("y", y), ("z", z))]
    areas = [_when(t, w).alias(n) for n, t in (("area_now", a), ("area_later", b), ("gain", b & ~a), ("loss", a & ~b), ("stable", a & b))]
    out = cells.groupBy(*by).agg(*areas, *sums)
    for s, n in (("0", "area_now"), ("1", "area_later")):
        lat, lon = geo.centroid(F.col(f"x{s}"), F.col(f"y{s}"), F.col(f"z{s}"))
        out = out.withColumn(f"lat{s}", F.when(F.col(n) > 0, lat)).withColumn(f"lon{s}", F.when(F.col(n) > 0, lon))
    ends = [F.col(c) for c in ("lat0", "lon0", "lat1", "lon1")]
    change = F.when(F.col("area_now") > 0, (F.col("area_later") / F.col("area_now") - 1) * 100)
    return out.select(*by, "area_now", "area_later", change.alias("change_pct"), "lat0", "lon0", "lat1", "lon1", geo.haversine_km(*ends).alias("shift_km"), geo.bearing(*ends).alias("bearing"), "gain", "loss", "stable")


def agreement(cells: DataFrame, by: Sequence[str], predicted: str, truth: str, area: str = "km2") -> DataFrame:
    """Area-weighted sensitivity, specificity, true skill, Sorensen overlap, commission and omission."""
    p, t, w = F.col(predicted), F.col(truth), F.col(area)
    s = cells.groupBy(*by).agg(_when(p & t, w).alias("tp"), _when(p & ~t, w).alias("fp"), _when(~p & t, w).alias("fn"), _when(~p & ~t, w).alias("tn"))
    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    floor = lambda x: F.greatest(x, F.lit(1e-9))
    true, false = floor(c["tp"] + c["fn"]), floor(c["tn"] + c["fp"])
    s = s.withColumn("sens", c["tp"] / true).withColumn("spec", c["tn"] / false)
    return s.select(*by, "sens", "spec", (F.col("sens") + F.col("spec") - 1).alias("tss"), (2 * c["tp"] / floor(2 * c["tp"] + c["fp"] + c["fn"])).alias("sorensen"), (c["fp"] / true).alias("commission"), (c["fn"] / true).alias("omission"))


def latitude_edges(cells: DataFrame, by: Sequence[str], state: str, area: str = "km2") -> DataFrame:
    """by, edge_low, edge_high: latitudes below which 5 and 95 per cent of the area lie."""
    out = weighted_quantiles(cells.where(F.col(state)), "lat", area, (0.05, 0.95), by)
    return out.withColumnsRenamed({"q0": "edge_low", "q1": "edge_high"})


def _shift(v: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Great-circle shifts in km of weighted mean vectors; one and two: weights (replicates, cells)."""
    a, b = one @ v, two @ v
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cross = np.linalg.norm(np.cross(a, b), axis=1)
        out = EARTH_KM * np.arctan2(cross, np.einsum("ij,ij->i", a, b))
    return np.where((na > 0) & (nb > 0), out, np.nan)


def resampled_shift(cells: DataFrame, by: str, n: int = 300, seed: int = 0, noise_se: float = 2.0) -> DataFrame:
    """by, km, se, low, high, detectable, p: the bootstrap of a range shift over clusters, and the label-swap test.

    cells: by, cluster, lat, lon, km2, now, later. Clusters are summed first, so that a group's task holds one row for
    each cluster; replicates draw or swap clusters, the same in both states.
    """
    x, y, z = geo.unit_xyz(F.col("lat"), F.col("lon"))
    parts = {"x": x, "y": y, "z": z}
    sums = [_when(F.col(s), v * F.col("km2")).alias(f"{k}{i}") for i, s in (("0", "now"), ("1", "later")) for k, v in parts.items()]
    clusters = cells.groupBy(by, "cluster").agg(*sums)
    kind = dict(cells.dtypes)[by]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster")
        a, b = (group[[f"{k}{i}" for k in "xyz"]].to_numpy() for i in "01")
        m = len(group)
        v = np.concatenate([a, b])
        weights = lambda one, two: (np.concatenate([one, np.zeros_like(one)], axis=1), np.concatenate([np.zeros_like(two), two], axis=1))
        ones = np.ones((1, m))
        km = _shift(v, *weights(ones, ones))[0]
        rng = np.random.default_rng(seed)
        draws = rng.multinomial(m, np.full(m, 1 / m), size=n).astype(float)
        boot = _shift(v, *weights(draws, draws))
        boot = boot[np.isfinite(boot)]
        swap = (rng.random((n, m)) < 0.5).astype(float)
        null = _shift(v, np.concatenate([1 - swap, swap], axis=1), np.concatenate([swap, 1 - swap], axis=1))
        se = float(boot.std(ddof=1)) if len(boot) > 2 else float("nan")
        low, high = np.quantile(boot, [0.025, 0.975]) if len(boot) > 2 else (np.nan, np.nan)
        p = (np.sum(null[np.isfinite(null)] >= km) + 1) / (n + 1) if np.isfinite(km) else np.nan
        return pd.DataFrame({by: [group[by].iloc[0]], "km": [km], "se": [se], "low": [low], "high": [high], "detectable": [bool(km > noise_se * se)], "p": [p]})

    return clusters.groupBy(by).applyInPandas(run, f"{by} {kind}, km double, se double, low double, high double, detectable boolean, p double")
