"""Occurrence cleaning and running means over streams: the batch plans, fed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_col, cell_row
from ..operators.occurrence import certain, valid_coordinates, wild


def clean_stream(records: DataFrame, time: str = "ts", late: str = "7 days") -> DataFrame:
    """Valid records of a stream, each identity once within the watermark."""
    good = records.where(valid_coordinates(F.col("lat"), F.col("lon")) & certain(F.col("uncertainty")) & wild(F.col("established")) & F.col("year").isNotNull())
    return good.withWatermark(time, late).dropDuplicatesWithinWatermark(["dataset", "identity"])


def cell_counts(clean: DataFrame, time: str = "ts", window: str = "1 day") -> DataFrame:
    """Counts of cells by event-time window; state older than the watermark is dropped."""
    return clean.groupBy(F.window(time, window), cell_row(F.col("lat")).alias("grid_row"), cell_col(F.col("lon")).alias("grid_col")).agg(F.count("*").alias("n"), F.max("year").alias("year_max"))


def merge_batch(path: str):
    """A foreachBatch sink that is idempotent: each batch replaces its own partition of the table."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return write
