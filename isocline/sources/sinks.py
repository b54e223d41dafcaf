"""Writers: partitioned tables, shards along a curve, pyramids, checksummed manifests, appends that refuse duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.climate import lite_class
from ..functions.geo import morton
from .tables import tile_of


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "error") -> None:
    """A zstd Parquet table; the committer makes it appear whole. An empty result raises rather than leave an empty table."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    out = df.repartition(*[F.col(c) for c in by]) if by else df
    out.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def write_tiles(cells: DataFrame, path: str) -> None:
    """Cells partitioned by tile and sorted by row, so that readers prune both."""
    at = cells.withColumn("tile", tile_of(F.col("grid_row"), F.col("grid_col")))
    at.repartition("tile").sortWithinPartitions("tile", "grid_row", "grid_col").write.option("compression", "zstd").partitionBy("tile").parquet(path)


def sharded(df: DataFrame, group: str, size: int, lat: str = "lat", lon: str = "lon", key: str = "place_id") -> DataFrame:
    """shard and slot of each row: a group's rows along the Morton curve, in equal shards of at most that many."""
    z = morton(F.floor((F.col(lon) + 180) * 100), F.floor((F.col(lat) + 90) * 100), 16)
    at = df.withColumn("_z", z)
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_z", key)) - 1
    shards = F.ceil(n / size)
    out = at.withColumn("shard", F.floor(place * shards / n).cast("int"))
    return out.withColumn("slot", (F.row_number().over(Window.partitionBy(group, "shard").orderBy("_z", key)) - 1).cast("int")).drop("_z")


def misplaced(shards: DataFrame, rows: DataFrame, group: str, key: str = "place_id") -> DataFrame:
    """Rows that are in no shard."""
    return rows.join(shards, [group, key], "left_anti")


def pyramid(cells: DataFrame, factors: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """factor, r, c, code, lite: the largest code of each block at each level, coarsest first."""
    at = cells.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    block = lambda c: F.floor(F.col(c) / F.col("factor")).cast("int")
    pooled = at.groupBy("factor", block("grid_row").alias("r"), block("grid_col").alias("c")).agg(F.max("code").alias("code"))
    return pooled.withColumn("lite", lite_class(F.col("code")))


def manifest(df: DataFrame, by: str) -> DataFrame:
    """by, rows, checksum: a digest of each part's rows whatever their order, in constant memory."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    sums = df.groupBy(by).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("_x"), F.sum(row.cast("decimal(38,0)")).alias("_s"))
    return sums.select(by, "rows", F.sha2(F.concat_ws(":", "rows", "_x", F.col("_s").cast("string")), 256).alias("checksum"))


def appended(existing: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The existing rows and those new ones whose key isn't there yet, once each."""
    fresh = more.dropDuplicates([key]).join(existing, key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
