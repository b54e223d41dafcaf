"""Survey operators: cycles, effort, detections, rarefaction, cell sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_cycles(plots: DataFrame, state: str, cycle: str, sub: str, year: str, complete: float, interval: float) -> DataFrame:
    """state, first, last, years, ok: cycles without parts, or with enough plots beside the median of the state's others."""
    g = plots.groupBy(state, cycle).agg(F.count("*").alias("n"), F.max(sub).alias("parts"), F.median(year).alias("t"))
    ref = g.where("parts > 0").groupBy(state).agg(F.median("n").alias("ref"))
    whole = g.join(ref, state, "left").where((F.col("parts") == 0) | (F.col("n") >= complete * F.col("ref")))
    years = F.max("t") - F.min("t")
    return whole.groupBy(state).agg(F.min(cycle).alias("first"), F.max(cycle).alias("last"), years.alias("years"), ((F.count("*") >= 2) & (years >= interval)).alias("ok"))


def effort_blocks(rows: DataFrame, period: str, n: int) -> DataFrame:
    """block_row, block_col, p1, p2: rows of each period in blocks of n by n cells."""
    at = rows.groupBy(F.floor(F.col("grid_row") / n).cast("int").alias("block_row"), F.floor(F.col("grid_col") / n).cast("int").alias("block_col"))
    return at.agg(*[F.sum(F.when(F.col(period) == k, 1).otherwise(0)).alias(f"p{k}") for k in (1, 2)])


def detections(rows: DataFrame, first: tuple[int, int], second: tuple[int, int], least: int) -> DataFrame:
    """route, species, distinct years of detection in both windows (a, b), and whether they are enough (p1, p2)."""
    years = rows.groupBy("route", "species").agg(*[F.countDistinct(F.when(F.col("y").between(*w), F.col("y"))).alias(n) for n, w in (("a", first), ("b", second))])
    return years.withColumn("p1", F.col("a") >= least).withColumn("p2", F.col("b") >= least)


def rarefied(plots: DataFrame, block: str, window: str, seen: str, draw: Column, plot: str, cap: int, least: int) -> DataFrame:
    """block, plots, before, after: presence among the same number of drawn plots of either window (1 and 2)."""
    group = Window.partitionBy(block, window)
    drawn = plots.withColumn("_k", F.row_number().over(group.orderBy(draw, plot))).withColumn("_n", F.count("*").over(group))
    sizes = drawn.groupBy(block).agg(F.least(F.min(F.when(F.col(window) == 1, F.col("_n"))), F.min(F.when(F.col(window) == 2, F.col("_n"))), F.lit(cap).cast("long")).alias("plots"))
    taken = drawn.join(sizes, block).where((F.col("_k") <= F.col("plots")) & (F.col("plots") >= least))
    side = lambda w: F.bool_or(F.when(F.col(window) == w, F.col(seen)))
    return taken.groupBy(block, "plots").agg(side(1).alias("before"), side(2).alias("after"))


def route_cells(routes: DataFrame, presence: DataFrame, scores: DataFrame) -> DataFrame:
    """Cells of routes: mean position, presence in either window, number of routes, mean scores; cells without scores go."""
    met = routes.join(presence, "route", "left").join(scores, ["grid_row", "grid_col"])
    ever = lambda p: F.bool_or(F.coalesce(F.col(p), F.lit(False)))
    return met.groupBy("grid_row", "grid_col").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), ever("p1").alias("p1"), ever("p2").alias("p2"), F.countDistinct("route").alias("routes"), F.avg("score1").alias("score1"), F.avg("score2").alias("score2"))
