"""Joins by distance: every one is an equi-join on grid buckets, then an exact filter.

Points are put into buckets of a size near the radius; the other side is exploded into its neighbouring buckets, more of
them in longitude towards the poles. No join compares all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, unit_xyz
from .graph import _folder

KM_PER_DEGREE = EARTH_KM * math.pi / 180
#: A search for nearest rows begins with the radius itself where buckets hold at most so many pairs, else with one of so many levels.
FEW_PAIRS, LEVELS = 10_000_000, 8


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def within_radius(left: DataFrame, right: DataFrame, km: float, names: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Pairs of rows at most km apart, with their distance in `km`; right's columns get the prefix r_.

    Buckets are half as high as the radius. A right point is copied into the bands that its radius meets and the buckets of
    longitude that it spans there; all of them where it holds a pole. Most others fail by their chord, before any distance.
    Plans take the copies for as few as the points, so that the join is always a sorted one: no side is broadcast.
    """
    lat, lon = names
    size = max(km / KM_PER_DEGREE, 1e-6)
    high = size / 2
    count = max(1, math.floor(360 / max(high, 360 / 3600)))
    wide = 360 / count
    a = left.withColumn("_b", _bucket(F.col(lat), high)).withColumn("_l", F.pmod(_bucket(F.col(lon) + 180, wide), F.lit(count)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    phi = F.col(f"r_{lat}")
    over = size * (1 + 1e-9) + 1e-9
    b = b.withColumn("_b", F.explode(F.sequence(_bucket(phi - over, high), _bucket(phi + over, high))))
    span = F.when(F.abs(phi) + over >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(over, 90.0))) / F.cos(F.radians(phi))))) + 1e-9)
    at = lambda d: _bucket(F.col(f"r_{lon}") + 180 + d, wide)
    b = b.withColumn("_l", F.explode(F.when(2 * span >= 360 - 2 * wide, F.sequence(F.lit(0), F.lit(count - 1))).otherwise(F.transform(F.sequence(at(-span), at(span)), lambda k: F.pmod(k, F.lit(count))))))
    a = a.withColumns(dict(zip(("_x", "_y", "_z"), unit_xyz(F.col(lat), F.col(lon)), strict=True)))
    b = b.withColumns(dict(zip(("_u", "_v", "_w"), unit_xyz(phi, F.col(f"r_{lon}")), strict=True)))
    near = F.col("_x") * F.col("_u") + F.col("_y") * F.col("_v") + F.col("_z") * F.col("_w") >= math.cos(math.radians(min(size, 180.0))) - 1e-12
    joined = a.hint("merge").join(b, ["_b", "_l"]).where(near).withColumn("km", haversine_km(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}")))
    return joined.where(F.col("km") <= km).drop("_b", "_l", "_x", "_y", "_z", "_u", "_v", "_w")


def _first_radius(spots: DataFrame, sites: DataFrame, km: float, k: int) -> float:
    """The largest of km, km / 4, km / 16 and so on that brings each spot a bounded number of sites on average, by counts in buckets."""
    radii = [km / 4**j for j in range(LEVELS)]
    cells = F.array(*[F.struct(F.lit(j).alias("j"), _bucket(F.col("lat"), r / KM_PER_DEGREE).alias("b"), _bucket(F.col("lon"), r / KM_PER_DEGREE).alias("l")) for j, r in enumerate(radii)])
    of = lambda df, n, m: df.select(F.explode(cells).alias("c"), F.lit(n).alias("n"), F.lit(m).alias("m"))
    met = of(spots, 1, 0).unionByName(of(sites, 0, 1)).groupBy("c.j", "c.b", "c.l").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    pairs = {r.j: r.pairs for r in met.groupBy("j").agg(F.sum(9.0 * F.col("n") * F.col("m")).alias("pairs")).collect()}
    most = max(FEW_PAIRS, 32 * k * spots.count())
    return next((r for j, r in enumerate(radii) if pairs.get(j, 0) <= most), radii[-1])


def _nearest_sites(spots: DataFrame, sites: DataFrame, km: float, k: int) -> DataFrame:
    """lat, lon, best: the k nearest (km, near) of each spot, `ids` being a site's k smallest keys.

    Radii grow: a spot that has k rows within one is done, for no row beyond it is nearer. Only the others meet the next one.
    """
    by = Window.partitionBy("lat", "lon").orderBy("km", F.col("r_ids")[0])
    out, radius = None, _first_radius(spots, sites, km, k)
    while True:
        pairs = within_radius(spots, sites, radius).select("lat", "lon", "km", "r_ids")
        if k == 1:
            best = pairs.groupBy("lat", "lon").agg(F.array(F.min(F.struct("km", F.col("r_ids")[0]["near"].alias("near")))).alias("best"))
        else:  # the k nearest rows stand at the k nearest sites
            rows = pairs.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= k).select("lat", "lon", F.explode(F.transform("r_ids", lambda x: F.struct(F.col("km").alias("km"), x["near"].alias("near")))).alias("r"))
            best = rows.groupBy("lat", "lon").agg(F.slice(F.sort_array(F.collect_list("r")), 1, k).alias("best"))
        if radius < km:
            best = best.where(F.size("best") >= k).checkpoint()
            spots = spots.join(best, ["lat", "lon"], "left_anti").checkpoint()
        out = best if out is None else out.unionByName(best)
        if radius >= km or spots.isEmpty():
            return out
        radius = min(km, radius * 4)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, km: float, k: int = 1) -> DataFrame:
    """left's key, right's key, km of the k nearest within the radius; ties go to the smaller right key.

    Rows at one position are one spot, and at most k of one site's rows can be nearest, so that distances are between
    different positions only.
    """
    _folder(left.sparkSession)
    order = Window.partitionBy("lat", "lon").orderBy("near")
    near = right.select("lat", "lon", F.col(right_key).alias("near")).dropna(subset=["lat", "lon"]).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    sites = near.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("near"))).alias("ids")).checkpoint()
    spots = left.select("lat", "lon").dropna().distinct().checkpoint()
    rows = left.select(key, "lat", "lon").join(_nearest_sites(spots, sites, km, k), ["lat", "lon"])
    if k == 1:
        best = rows.groupBy(key).agg(F.min(F.col("best")[0]).alias("b"))
    else:
        # only the k positions with the nearest first rows count where a key has more
        first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("best")[0]))
        rows = rows.withColumn("_place", first).where(F.col("_place") <= k)
        best = rows.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")).select(key, F.explode("best").alias("b"))
    return best.select(key, "b.near", "b.km")


def neighbours(rows: int = 1) -> Column:
    """Offsets of a square of cells, nearest first."""
    offsets = sorted(((i * i + j * j, i, j) for i in range(-rows, rows + 1) for j in range(-rows, rows + 1)))
    return F.array(*[F.struct(F.lit(d).alias("d2"), F.lit(i).alias("di"), F.lit(j).alias("dj")) for d, i, j in offsets])


def snap_to_valid(points: DataFrame, valid: DataFrame, key: str, rings: int = 3, wrap: int = 8640) -> DataFrame:
    """key, grid_row, grid_col, d2 of the nearest valid cell within the rings; ties by row and column. The date line wraps."""
    spread = points.select(key, F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), F.explode(neighbours(rings)).alias("o"))
    spread = spread.select(key, (F.col("_r") + F.col("o.di")).alias("grid_row"), F.pmod(F.col("_c") + F.col("o.dj"), F.lit(wrap)).alias("grid_col"), F.col("o.d2").alias("d2"))
    hits = spread.join(valid.select("grid_row", "grid_col").distinct(), ["grid_row", "grid_col"])
    best = hits.groupBy(key).agg(F.min(F.struct("d2", "grid_row", "grid_col")).alias("b"))
    return best.select(key, "b.grid_row", "b.grid_col", "b.d2")


def filled_change(cells: DataFrame, key: str, change: str, rings: int = 3) -> DataFrame:
    """key, change, filled: cells without a change, such as ocean, take that of the nearest cell within the rings that has one; others stay null."""
    known, lost = cells.where(F.col(change).isNotNull()), cells.where(F.col(change).isNull())
    near = snap_to_valid(lost, known, key, rings).select(key, "grid_row", "grid_col")
    taken = near.join(known.select("grid_row", "grid_col", change), ["grid_row", "grid_col"]).select(key, change)
    rest = lost.select(key).join(taken, key, "left").withColumn("filled", F.col(change).isNotNull())
    return known.select(key, change, F.lit(False).alias("filled")).unionByName(rest)


def block_mean(cells: DataFrame, value: str, n: int) -> DataFrame:
    """block_row, block_col, mean of what is there, and the share of the block's cells that is."""
    at = cells.withColumn("block_row", F.floor(F.col("grid_row") / n).cast("int")).withColumn("block_col", F.floor(F.col("grid_col") / n).cast("int"))
    return at.groupBy("block_row", "block_col").agg(F.avg(value).alias("mean"), (F.count(value) / (n * n)).alias("land"))


def widening_mean(points: DataFrame, cells: DataFrame, key: str, value: str, radii: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The mean of valid cells in the smallest square of these radii that has any."""
    most = max(radii)
    spread = points.select(key, F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), F.explode(neighbours(most)).alias("o"))
    spread = spread.select(key, (F.col("_r") + F.col("o.di")).alias("grid_row"), (F.col("_c") + F.col("o.dj")).alias("grid_col"), F.greatest(F.abs("o.di"), F.abs("o.dj")).alias("ring"))
    hit = spread.join(cells.select("grid_row", "grid_col", value), ["grid_row", "grid_col"], "left")
    means = [F.avg(F.when(F.col("ring") <= r, F.col(value))) for r in radii]
    return hit.groupBy(key).agg(F.coalesce(*means).alias("mean"))


def bilinear(points: DataFrame, grid: DataFrame, key: str, value: str, lat0: float, lon0: float, step: float, wrap: int) -> DataFrame:
    """key, value: the four grid points around each point, weighted; weights of missing ones go to the others."""
    y, x = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    p = points.select(key, F.floor(y).alias("i"), F.floor(x).alias("j"), (y - F.floor(y)).alias("v"), (x - F.floor(x)).alias("u"))
    corners = F.array(*[F.struct((F.col("i") + a).alias("gi"), F.pmod(F.col("j") + b, F.lit(wrap)).alias("gj"), ((F.col("v") if a else 1 - F.col("v")) * (F.col("u") if b else 1 - F.col("u"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    spread = p.select(key, F.explode(corners).alias("c")).select(key, "c.gi", "c.gj", "c.w")
    met = spread.join(grid.select("gi", "gj", value), ["gi", "gj"]).where(F.col(value).isNotNull())
    return met.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("value"))


def kernel_mean(points: DataFrame, cells: DataFrame, key: str, value: str, land: str, length_km: float, least_land: float = 0.05) -> DataFrame:
    """Gaussian means cut at two lengths: weighted by land share, or not where the land's part is too small.

    Weights depend on positions only, so that cells at one position are summed before they meet each different position once.
    """
    v, share = F.col(value), F.col(land)
    sums = (F.sum(share).alias("l"), F.count("*").alias("n"), F.sum(share * v).alias("lv"), F.sum(v).alias("v"))
    sites = cells.dropna(subset=["lat", "lon"]).groupBy("lat", "lon").agg(*sums)
    spots = points.select("lat", "lon").dropna().distinct()
    w = F.exp(-0.5 * F.pow(F.col("km") / length_km, F.lit(2.0)))
    weighted = lambda by, of: by.agg(*[F.sum(c).alias(n) for n, c in of.items()])
    pairs = within_radius(spots, sites, 2 * length_km).groupBy("lat", "lon")
    near = weighted(pairs, {"wl": w * F.col("r_l"), "w": w * F.col("r_n"), "vl": w * F.col("r_lv"), "v": w * F.col("r_v")})
    sums = weighted(points.select(key, "lat", "lon").join(near, ["lat", "lon"]).groupBy(key), {n: F.col(n) for n in ("wl", "w", "vl", "v")})
    return sums.select(key, F.when(F.col("wl") / F.col("w") > least_land, F.col("vl") / F.col("wl")).otherwise(F.col("v") / F.col("w")).alias("mean"))


def inverse_distance(points: DataFrame, places: DataFrame, key: str, place_key: str, value: str, km: float, k: int = 5) -> DataFrame:
    """Means of the k nearest places within the radius, weighted by the inverse square of the distance."""
    best = nearest(points, places, key, place_key, km, k)
    met = best.join(places.select(F.col(place_key).alias("near"), value), "near")
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(1e-6)), F.lit(2.0))
    return met.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.count("*").alias("n"))


def dilate(cells: DataFrame, times: int = 1) -> DataFrame:
    """Cells and all that are at most so many steps away, diagonals included."""
    spread = cells.select("grid_row", "grid_col").distinct().select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), F.explode(neighbours(times)).alias("o"))
    return spread.select((F.col("_r") + F.col("o.di")).alias("grid_row"), (F.col("_c") + F.col("o.dj")).alias("grid_col")).distinct()


def erode(cells: DataFrame) -> DataFrame:
    """Cells whose four neighbours are there too."""
    sides = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    mine = cells.select("grid_row", "grid_col").distinct()
    votes = mine.withColumn("o", F.explode(sides)).select((F.col("grid_row") + F.col("o.di")).alias("grid_row"), (F.col("grid_col") + F.col("o.dj")).alias("grid_col"))
    full = votes.groupBy("grid_row", "grid_col").agg(F.count("*").alias("n")).where("n = 4")
    return mine.join(full, ["grid_row", "grid_col"], "left_semi")


def outline(cells: DataFrame) -> DataFrame:
    """Edges between a cell of the set and the right or lower neighbour outside it, or the reverse: grid_row, grid_col, side."""
    mine = cells.select("grid_row", "grid_col").distinct()
    both = [mine.select("grid_row", "grid_col", F.lit(s).alias("side")).unionByName(mine.select((F.col("grid_row") - dr).alias("grid_row"), (F.col("grid_col") - dc).alias("grid_col"), F.lit(s).alias("side"))) for s, dr, dc in (("right", 0, 1), ("below", 1, 0))]
    return both[0].unionByName(both[1]).groupBy("grid_row", "grid_col", "side").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def inverted(mask: DataFrame, whole: DataFrame) -> DataFrame:
    return whole.join(mask, ["grid_row", "grid_col"], "left_anti")


def box_pixels(cells: DataFrame, n: int) -> DataFrame:
    """pixel_row, pixel_col of the n by n finer pixels of each cell, beside the cell's columns."""
    at = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    out = at.withColumn("pixel_row", (F.col("grid_row") * n + F.floor(F.col("_k") / n)).cast("int"))
    return out.withColumn("pixel_col", (F.col("grid_col") * n + F.col("_k") % n).cast("int")).drop("_k")


def pyramid_level(height: Column, width: Column, wanted: int, factors: Sequence[int] = (8, 4, 2, 1)) -> Column:
    """The coarsest factor at which a view still has so many cells along its longer side; the finest one otherwise."""
    out = F.lit(factors[-1])
    for f in reversed(factors[:-1]):
        out = F.when(F.greatest(height, width) / f >= wanted, F.lit(f)).otherwise(out)
    return out
