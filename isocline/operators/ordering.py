"""Running totals in the order of a value, without gathering all rows in one task.

Distinct values are counted first. They are dealt into buckets by bounds that one pass estimates; totals of buckets are
few and are summed in order, totals within a bucket are windows of that bucket alone. Results are exact whatever the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def running_totals(df: DataFrame, value: str, measures: dict[str, Column], by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """by, value and for each measure its total at the value, before it and up to it: m, m_before, m_upto."""
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(m) for m, c in measures.items()])
    bounds = counted.agg(F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(1000)).alias("b")).first().b or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col(value))) if bounds else F.lit(0)
    dealt = counted.withColumn("_bucket", bucket)
    names = list(measures)
    sums = dealt.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in names])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_at") for m in names])
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(offsets, [*by, "_bucket"])
    for m in names:
        upto = F.col(f"_{m}_at") + F.sum(m).over(inside)
        out = out.withColumn(f"{m}_upto", upto).withColumn(f"{m}_before", F.col(f"{m}_upto") - F.col(m))
    return out.select(*by, value, *names, *[f"{m}_{e}" for m in names for e in ("before", "upto")])


def ranked(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `rank` (ties averaged), `below` and `upto` (shares of rows), `mid` (their mean); null values have none."""
    by = list(by)
    totals = running_totals(df, value, {"_n": F.count("*")}, by)
    whole = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    totals = totals.join(whole, by) if by else totals.join(F.broadcast(whole))
    stats = totals.select(*by, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias("rank"), (F.col("_n_before") / F.col("_all")).alias("below"), (F.col("_n_upto") / F.col("_all")).alias("upto"))
    return df.join(stats, [*by, value], "left").withColumn("mid", (F.col("below") + F.col("upto")) / 2)


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and q0, q1, ...: the first value at which the share of the weight is reached."""
    by = list(by)
    totals = running_totals(df, value, {"_w": F.sum(weight)}, by)
    whole = totals.groupBy(*by).agg(F.max("_w_upto").alias("_all"))
    totals = totals.join(whole, by) if by else totals.join(F.broadcast(whole))
    return totals.groupBy(*by).agg(*[F.coalesce(F.min(F.when(F.col("_w_upto") / F.col("_all") >= s, F.col(value))), F.max(value)).alias(f"q{k}") for k, s in enumerate(shares)])
