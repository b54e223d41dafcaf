"""Embedding columns: which rows take part, and matrices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def with_copies(df: DataFrame, vector: str) -> DataFrame:
    """A column `copy` that numbers the rows of each vec_id, so that (vec_id, copy) names a row."""
    return df.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64(vector), F.col(vector).cast("string"))))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
