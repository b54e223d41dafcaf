"""Ordered operators: running means, crossings, runs, seasons of years, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .occurrence import first_by


def running_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, before: int = 10, after: int = 9) -> DataFrame:
    """A column `running`: the mean of the frame, null unless the frame is whole."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumn("running", F.when(F.count(value).over(frame) == before + after + 1, F.avg(value).over(frame)))


def first_crossings(df: DataFrame, keys: Sequence[str], order: str, value: str, reference: Column, levels: Sequence[float], before: int = 10, after: int = 9) -> DataFrame:
    """keys, level, crossed (0: never): the first place where the running mean less the reference mean reaches a level."""
    means = running_mean(df, keys, order, value, before, after)
    base = df.where(reference).groupBy(*keys).agg(F.avg(value).alias("_base"))
    level = F.explode(F.array(*map(F.lit, levels))).alias("level")
    rise = means.join(base, list(keys)).select(*keys, order, (F.col("running") - F.col("_base")).alias("_rise"), level)
    return rise.groupBy(*keys, "level").agg(F.coalesce(F.min(F.when(F.col("_rise") >= F.col("level"), F.col(order))), F.lit(0)).alias("crossed"))


def longest_run(df: DataFrame, keys: Sequence[str], order: str, test: Column) -> DataFrame:
    """keys, longest: the longest unbroken run of true rows within a key (gaps and islands)."""
    by_key = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_test", F.coalesce(test, F.lit(False)))
    island = F.row_number().over(by_key) - F.row_number().over(Window.partitionBy(*keys, "_test").orderBy(order))
    runs = marked.withColumn("_island", island).groupBy(*keys, "_test", "_island").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_test"), F.col("_n"))), F.lit(0)).alias("longest"))


def december_shift(df: DataFrame, keys: Sequence[str], year: str, month: str, value: str, how: str = "sum") -> DataFrame:
    """keys, season_year, season (0 from December), value; years without all twelve of their months are dropped."""
    season = F.floor((F.col(month) % 12) / 3).cast("int")
    shifted = df.withColumn("season", season).withColumn("season_year", F.col(year) + (F.col(month) == 12).cast("int"))
    agg = F.sum(value) if how == "sum" else F.avg(value)
    seasons = shifted.groupBy(*keys, "season_year", "season").agg(agg.alias("value"), F.count(value).alias("_n"))
    whole = Window.partitionBy(*keys, "season_year")
    return seasons.withColumn("_months", F.sum("_n").over(whole)).where("_months = 12").drop("_n", "_months")


def detrended(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """A column `residual`: the value less its linear trend, the mean kept."""
    w = Window.partitionBy(*keys)
    t = F.col(order) - F.avg(order).over(w)
    slope = F.covar_samp(value, order).over(w) / F.var_samp(order).over(w)
    return df.withColumn("residual", F.when(F.count("*").over(w) > 1, F.col(value) - slope * t).otherwise(F.col(value)))


def covered_climatology(df: DataFrame, keys: Sequence[str], month: str, year: str, value: str, years: int, coverage: float = 0.95) -> DataFrame:
    """keys, month, mean, share, covered: monthly means and whether enough of the years are there."""
    out = df.groupBy(*keys, month).agg(F.avg(value).alias("mean"), (F.countDistinct(year) / years).alias("share"))
    return out.withColumn("covered", F.col("share") >= coverage)


def merged_means(parts: DataFrame, keys: Sequence[str], mean: str, count: str) -> DataFrame:
    """Means of parts, weighted by their counts."""
    return parts.groupBy(*keys).agg((F.sum(F.col(mean) * F.col(count)) / F.sum(count)).alias("mean"), F.sum(count).alias("n"))


def latest_version(df: DataFrame, keys: Sequence[str], *version: str) -> DataFrame:
    return first_by(df, keys, *[F.col(v).desc() for v in version])
