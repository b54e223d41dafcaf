"""Nearest rows in a whitened metric, spaced picks, variability models and the sigma table.

Targets are dealt into blocks and the pool into slices; each block meets each slice in one task, and only the best of a
slice are shuffled. Nothing that grows with the pool is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric

BLOCK, SLICE = 1024, 16_384


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a stream sorted by the keys."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        for key, part in frame.groupby(keys, sort=True):
            if held and key != last:
                yield pd.concat(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held)


def _meeting(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of targets (side 0) and pool (side 1) sorted by block and slice, so that each pair of rows meets once."""
    blocks = max(1, -(-targets.count() // BLOCK))
    slices = max(1, -(-pool.count() // SLICE))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vec = F.col("vec").cast("array<double>")
    m = F.col("m") if "m" in targets.columns else F.lit(None).cast("array<double>")
    weight = F.col("weight").cast("double") if "weight" in pool.columns else F.lit(1.0)
    t = targets.select(F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int").alias("block"), spread(slices).alias("slice"), F.lit(0).alias("side"), F.col("target").cast("long").alias("id"), vec.alias("vec"), m.alias("m"), F.lit(0.0).alias("weight"))
    p = pool.select(spread(blocks).alias("block"), F.pmod(F.xxhash64("near"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("side"), F.col("near").cast("long").alias("id"), vec.alias("vec"), F.lit(None).cast("array<double>").alias("m"), weight.alias("weight"))
    return t.unionByName(p).repartition("block", "slice").sortWithinPartitions("block", "slice", "side", "id")


def _distances(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each target with the ids, weights and squared distances of its group's pool rows."""
    a, b = group[group.side == 0], group[group.side == 1]
    if a.empty or b.empty:
        return
    rows, ids, weights = np.stack(b.vec.to_numpy()), b.id.to_numpy(), b.weight.to_numpy()
    for target, vector, matrix in zip(a.id, a.vec, a.m, strict=True):
        d = rows - np.asarray(vector)
        if matrix is not None:
            d = d @ np.asarray(matrix).reshape(d.shape[1], -1)
        yield target, ids, weights, np.einsum("ij,ij->i", d, d)


def nearest_rows(targets: DataFrame, pool: DataFrame, k: int = 1, exclude_same: bool = True) -> DataFrame:
    """(target, near, distance, place) of the k nearest pool rows: targets (target, vec, [m]), pool (near, vec).

    m, if there, is the target's own metric, a row-major square matrix. A target doesn't meet the pool row of its own id if
    exclude_same. Ties go to the smaller id; distances are float64.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["block", "slice"]):
            for target, ids, _, distance in _distances(group):
                if exclude_same:
                    distance = np.where(ids == target, np.inf, distance)
                n = min(k, len(ids))
                bar = np.partition(distance, n - 1)[n - 1]
                some = np.flatnonzero((distance <= bar) & np.isfinite(distance))
                some = some[np.lexsort((ids[some], distance[some]))][:n]
                yield pd.DataFrame({"target": target, "near": ids[some], "d2": distance[some]})

    best = _meeting(targets, pool).mapInPandas(run, "target long, near long, d2 double")
    place = F.row_number().over(Window.partitionBy("target").orderBy("d2", "near"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("target", "near", F.sqrt("d2").alias("distance"), "place")


def area_within(targets: DataFrame, pool: DataFrame, limit: float) -> DataFrame:
    """(target, cells, area): pool rows nearer than the limit and their weights' sum, summed where they meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["block", "slice"]):
            rows = [(t, int((d < limit * limit).sum()), float(w[d < limit * limit].sum())) for t, _, w, d in _distances(group)]
            if rows:
                yield pd.DataFrame(rows, columns=["target", "cells", "area"])

    parts = _meeting(targets, pool).mapInPandas(run, "target long, cells long, area double")
    return parts.groupBy("target").agg(F.sum("cells").alias("cells"), F.sum("area").alias("area"))


def spaced_sites(candidates: DataFrame, key: str, n: int, km: float) -> DataFrame:
    """(key, pick, near, distance): greedily the nearest candidates at least so far from those picked; a group at a time.

    candidates: key, near, distance, lat, lon; a group holds at most the candidates that nearest_rows was asked for.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["distance", "near"])
        a = np.radians(group.lat.to_numpy())
        b = np.radians(group.lon.to_numpy())
        xyz = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)
        taken: list[int] = []
        limit = 2 * np.sin(km / 6371.0088 / 2)
        for i in range(len(group)):
            if len(taken) == n:
                break
            if not taken or np.linalg.norm(xyz[taken] - xyz[i], axis=1).min() >= limit:
                taken.append(i)
        out = group.iloc[taken]
        return pd.DataFrame({key: out[key], "pick": np.arange(1, len(out) + 1), "near": out.near, "distance": out.distance})

    return candidates.groupBy(key).applyInPandas(pick, f"{key} long, pick int, near long, distance double")


def place_metrics(series: DataFrame, method: str = "shrinkage", floor: float = 0.10, min_var: float = 0.01) -> DataFrame:
    """(place, k, m, shrinkage, floored) from rows (place, year, vec): the whitening matrix of each place, row by row."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("year").vec.to_numpy()).astype(float)
        x, floored = numeric.floored_series(x, floor)
        if method == "shrinkage":
            m, alpha = numeric.shrinkage_metric(x)
        else:
            m, alpha = numeric.truncated_metric(x, min_var), float("nan")
        k = int((np.abs(m).sum(axis=0) > 0).sum())
        return pd.DataFrame({"place": [group.place.iloc[0]], "k": [k], "m": [m.ravel().tolist()], "shrinkage": [alpha], "floored": [floored]})

    return series.groupBy("place").applyInPandas(fit, "place long, k int, m array<double>, shrinkage double, floored int")


def sigma_table(spark: SparkSession, ks: tuple[int, ...] = tuple(range(1, 17)), top: float = 60.0, step: float = 0.02) -> DataFrame:
    """(k, i, sigma) at distances i * step: a table of fixed size."""
    n = round(top / step) + 1
    rows = [(k, i, numeric.chi_to_sigma(i * step, k)) for k in ks for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "i", "sigma"]), "k int, i int, sigma double")


def with_sigma(df: DataFrame, table: DataFrame, distance: str, k: str, top: float = 60.0, step: float = 0.02) -> DataFrame:
    """A column `sigma` by linear interpolation in the table; distances beyond its end take the last value."""
    at = F.least(F.col(distance), F.lit(top)) / step
    low = F.least(F.floor(at), F.lit(round(top / step) - 1)).cast("int")
    pairs = table.withColumn("above", F.lead("sigma").over(Window.partitionBy("k").orderBy("i"))).where("above is not null").withColumnsRenamed({"k": "_k", "i": "_i"})
    joined = df.withColumn("_low", low).join(F.broadcast(pairs), (F.col(k) == F.col("_k")) & (F.col("_low") == F.col("_i")))
    return joined.withColumn("sigma", F.col("sigma") + (F.col("above") - F.col("sigma")) * (at - F.col("_low"))).drop("_k", "_i", "_low", "above")
