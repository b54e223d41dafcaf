"""Look-ups and selections: usable cells, live trees, gazetteer ranks, names, polygons, change sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, land: Column, lat: Column, values: Sequence[str], least_land: float, least_lat: float) -> DataFrame:
    """Rows with enough land, beyond the latitude, and with all values there and finite."""
    finite = F.lit(True)
    for v in values:
        x = F.col(v).cast("double")
        finite = finite & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return df.where((land >= least_land) & (lat > least_lat) & finite)


def live_trees(trees: DataFrame, plots: DataFrame, species: DataFrame, least: float) -> DataFrame:
    """Trees that live, are thick enough, of a listed species and on a listed plot; the lists are semi-joined."""
    kept = trees.where(F.col("alive") & (F.col("diameter") >= least))
    return kept.join(species.select("species").distinct(), "species", "left_semi").join(plots.select("plot").distinct(), "plot", "left_semi")


def gazetteer_rank(places: DataFrame, text: str, region: int, n: int) -> DataFrame:
    """The n best places whose folded name begins with the text: in the region first, then exact names, then by population."""
    name = F.lower(F.trim("label"))
    return places.where(name.startswith(text.lower())).orderBy((F.col("country") == region).desc(), (name == text.lower()).desc(), F.col("pop").desc(), "label").limit(n)


def by_common_name(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left joined with right on the trimmed lower-case name; a null or blank name meets nothing."""
    key = lambda df: df.withColumn("_name", F.nullif(F.lower(F.trim(name)), F.lit("")))
    return key(left).join(key(right).drop(name), "_name").drop("_name")


def first_source(df: DataFrame, key: Sequence[str], order: Sequence[str], period: str) -> DataFrame:
    """For each key the values of the first source, in that order, that has the period; sources of other periods are refused."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    fit = df.where((F.col("period") == period) & (rank > 0) & F.col("value").isNotNull())
    return fit.groupBy(*key).agg(F.min_by(F.struct("source", "value"), rank).alias("_b")).select(*key, "_b.source", "_b.value")


def levels_reached(df: DataFrame, key: Sequence[str], levels: Sequence[float], least: int = 3) -> DataFrame:
    """key, level, models, median: values of the models that reach each warming level, offered where enough do.

    df: key, model, warming, value. Of a model the value at its first warming at or beyond the level counts.
    """
    each = df.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("warming") >= F.col("level"))
    first = each.groupBy(*key, "model", "level").agg(F.min_by("value", "warming").alias("value"))
    return first.groupBy(*key, "level").agg(F.count("*").alias("models"), F.median("value").alias("median")).where(F.col("models") >= least)


def polygons_of_points(points: DataFrame, edges: DataFrame, key: str, degrees: float = 1.0, band: float = 1.0) -> DataFrame:
    """key, polygon, inside: the polygon that holds a point; else the one with the nearest corner within so many degrees; else null.

    edges: polygon, x0, y0, x1, y1. A ray to the east is counted against the edges of its band of latitude, so that points
    meet only those. Of several polygons the first by name holds the point, and of equally near ones the first is taken.
    """
    row = lambda y: F.floor(y / band).cast("long")
    spans = edges.withColumn("_band", F.explode(F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")))))
    crosses = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    met = points.select(key, "x", "y", row(F.col("y")).alias("_band")).join(spans, "_band").where((F.col("y0") != F.col("y1")) & crosses)
    holds = met.groupBy(key, "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").groupBy(key).agg(F.min("polygon").alias("holds"))
    corner = edges.select("polygon", F.col("x0").alias("cx"), F.col("y0").alias("cy")).distinct()
    cell = lambda v: F.floor(v / degrees).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = corner.withColumn("o", F.explode(around)).withColumn("_i", cell(F.col("cx")) + F.col("o.i")).withColumn("_j", cell(F.col("cy")) + F.col("o.j")).drop("o")
    lost = points.join(holds, key, "left_anti").withColumn("_i", cell(F.col("x"))).withColumn("_j", cell(F.col("y"))).join(near, ["_i", "_j"])
    far = F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0))
    nearest = lost.withColumn("d", F.round(far, 9)).where(F.col("d") <= degrees * degrees).groupBy(key).agg(F.min(F.struct("d", "polygon"))["polygon"].alias("near"))
    out = points.select(key).join(holds, key, "left").join(nearest, key, "left")
    return out.select(key, F.coalesce("holds", "near").alias("polygon"), F.col("holds").isNotNull().alias("inside"))


def block_histogram(df: DataFrame, row: str, col: str, value: str, side: int, parent: int, bins: int) -> DataFrame:
    """Blocks of side by side cells: mean, counts of value's bins in [0, 1], and the number of the parent block that holds each."""
    r, c = F.floor(F.col(row) / side).cast("long"), F.floor(F.col(col) / side).cast("long")
    at = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int")
    counts = [F.count_if(at == b).alias(f"bin{b}") for b in range(bins)]
    out = df.groupBy(r.alias("r"), c.alias("c")).agg(F.avg(value).alias("mean"), *counts)
    return out.withColumn("parent", F.floor(F.col("r") / parent) * 10_000 + F.floor(F.col("c") / parent))
