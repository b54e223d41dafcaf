"""Cleaning of occurrence records and their aggregation to cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_col, cell_row

# Means of establishment that are dropped; periods of the counts.
NOT_WILD = ("MANAGED", "CULTIVATED", "CAPTIVE", "VAGRANT", "INVASIVE", "NATURALISED", "NATURALIZED")
PERIODS = {"n_1970_1999": (1970, 1999), "n_2000_2020": (2000, 2020), "n_2021_plus": (2021, 9999)}
BREEDING, WINTER = (5, 6, 7), (12, 1, 2)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Within the globe, not the null island, not equal, not both whole degrees; null is not valid."""
    near_zero = (F.abs(lat) < 1e-4) & (F.abs(lon) < 1e-4)
    whole = (lat == F.rint(lat)) & (lon == F.rint(lon))
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~near_zero & (lat != lon) & ~whole, F.lit(False))


def certain(uncertainty: Column, most: float = 10_000) -> Column:
    """An unknown uncertainty is kept."""
    return ~F.coalesce(uncertainty > most, F.lit(False))


def wild(established: Column, keep_introduced: bool = False) -> Column:
    upper = F.upper(F.coalesce(established, F.lit("")))
    drop = upper.isin("MANAGED", "CULTIVATED", "VAGRANT") if keep_introduced else upper.isin(*NOT_WILD) | upper.startswith("INTRODUCED")
    return ~drop


def loss_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, step_no, left): rows that pass all steps so far, in one pass and one small exchange."""
    so_far, counts = F.lit(True), [F.count("*").alias("input")]
    for name, test in steps:
        so_far = so_far & test
        counts.append(F.sum(F.when(so_far, 1).otherwise(0)).alias(name))
    row = df.agg(*counts)
    entries = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(n).alias("step"), F.coalesce(F.col(n), F.lit(0)).alias("left")) for k, n in enumerate(["input", *[s for s, _ in steps]])])
    return row.select(F.explode(entries).alias("e")).select("e.step_no", "e.step", "e.left")


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row of each key, the first in that order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def to_cells(df: DataFrame, events: Sequence[str]) -> DataFrame:
    """grid_row, grid_col, year_min, year_max, n_records, n_events and period counts, from lat, lon, year."""
    at = df.withColumn("grid_row", cell_row(F.col("lat"))).withColumn("grid_col", cell_col(F.col("lon")))
    periods = [F.sum(F.when(F.col("year").between(a, b), 1).otherwise(0)).alias(n) for n, (a, b) in PERIODS.items()]
    return at.groupBy("grid_row", "grid_col").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n_records"), F.countDistinct(F.struct(*events)).alias("n_events"), *periods)


def season_counts(df: DataFrame) -> DataFrame:
    """A cell's records by month (m00: unknown) and season, also by period."""
    at = df.withColumn("grid_row", cell_row(F.col("lat"))).withColumn("grid_col", cell_col(F.col("lon")))
    month = F.coalesce("month", F.lit(0))
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    columns = [n(month == m, f"m{m:02d}") for m in range(13)]
    for season, numbers in (("breeding", BREEDING), ("winter", WINTER)):
        columns.append(n(month.isin(*numbers), f"n_{season}"))
        columns += [n(month.isin(*numbers) & F.col("year").between(a, b), f"n_{season}{p[1:]}") for p, (a, b) in PERIODS.items() if b < 9999]
    return at.groupBy("grid_row", "grid_col").agg(*columns)


def route_rows(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with the target of the first of the columns that names one; keys: (kind, value, target), null if none does."""
    out = df
    for k, column in enumerate(columns):
        side = keys.where(F.col("kind") == column).select(F.col("value").alias(f"_v{k}"), F.col("target").alias(f"_t{k}"))
        out = out.join(side, F.col(column).cast("string") == F.col(f"_v{k}"), "left").drop(f"_v{k}")
    names = [f"_t{k}" for k in range(len(columns))]
    return out.withColumn("target", F.coalesce(*names)).drop(*names)


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of all frames; of equal keys, the one of the earliest frame, then the least by `order`."""
    tagged = [f.withColumn("source_no", F.lit(k)) for k, f in enumerate(frames)]
    whole = tagged[0]
    for f in tagged[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return first_by(whole, keys, F.col("source_no"), *[F.col(c) for c in order])


def search_rank(df: DataFrame, label: str, text: str, limit: int = 120) -> DataFrame:
    """Labels that hold the folded text: beginning with it first, then a word that does, then anywhere."""
    fold = lambda c: F.lower(F.regexp_replace(F.translate(c, "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"), r"[^0-9A-Za-z]+", " "))
    folded, asked = fold(F.col(label)), text.lower()
    rank = F.when(folded.startswith(asked), 0).when(folded.contains(" " + asked), 1).when(folded.contains(asked), 2)
    return df.withColumn("rank", rank).where("rank is not null").orderBy("rank", label).limit(limit)
