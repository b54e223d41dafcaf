"""Connected patches of cells: first within square blocks of the grid, then between the blocks' patches."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a block's side: what one task labels at once.
SIDE = 512


def _folder(spark) -> None:
    """Checkpoints go to spark.checkpoint.dir; a temporary folder serves only where that is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="isocline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def _label(rows: np.ndarray, cols: np.ndarray, wide: int) -> np.ndarray:
    """The smallest cell number of each cell's 4-neighbour patch."""
    number = rows.astype(np.int64) * wide + cols
    at = {n: i for i, n in enumerate(number.tolist())}
    parent = list(range(len(number)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for n, i in at.items():
        for j in (at.get(n + 1), at.get(n + wide)):
            if j is not None:
                a, b = find(i), find(j)
                if a != b:
                    a, b = (a, b) if number[a] < number[b] else (b, a)
                    parent[b] = a
    return number[[find(i) for i in range(len(number))]]


def _merged(edges: DataFrame) -> DataFrame:
    """(id, patch): the least label that each label of an edge reaches; labels jump to their label's label each round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.select(F.col("u").alias("id"), F.col("u").alias("patch")).distinct()
    while True:
        least = both.join(labels.withColumnsRenamed({"id": "v", "patch": "p"}), "v").groupBy(F.col("u").alias("id")).agg(F.min("p").alias("p"))
        lower = labels.join(least, "id", "left").select("id", "patch", F.least("patch", "p").alias("q"))
        jump = lower.select(F.col("id").alias("q"), F.col("q").alias("j"))
        after = lower.join(jump, "q", "left").select("id", F.least("q", "j").alias("new"), "patch").checkpoint()
        labels = after.select("id", F.col("new").alias("patch"))
        if after.where("new <> patch").isEmpty():
            return labels


def patches(cells: DataFrame, wide: int = 1 << 20) -> DataFrame:
    """grid_row, grid_col, patch: the smallest cell number of the 4-neighbour patch."""
    _folder(cells.sparkSession)
    at = cells.select(F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col")).distinct()
    block = lambda r, c: [F.floor(r / SIDE).alias("block_row"), F.floor(c / SIDE).alias("block_col")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group[["grid_row", "grid_col"]].assign(patch=_label(group.grid_row.to_numpy(), group.grid_col.to_numpy(), wide))

    local = at.withColumns({"block_row": block(F.col("grid_row"), F.col("grid_col"))[0], "block_col": block(F.col("grid_row"), F.col("grid_col"))[1]}).groupBy("block_row", "block_col").applyInPandas(run, "grid_row int, grid_col int, patch long").checkpoint()
    # Only cells on a block's last row or column have neighbours in another block.
    sides = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    rim = local.where(((F.col("grid_row") + 1) % SIDE == 0) | ((F.col("grid_col") + 1) % SIDE == 0)).withColumn("s", F.explode(sides))
    rim = rim.select((F.col("grid_row") + F.col("s.dr")).alias("grid_row"), (F.col("grid_col") + F.col("s.dc")).alias("grid_col"), F.col("patch").alias("u"))
    edges = rim.join(local.withColumnRenamed("patch", "v"), ["grid_row", "grid_col"]).where("u <> v").select("u", "v").distinct().checkpoint()
    if edges.isEmpty():
        return local
    merged = _merged(edges)
    return local.join(merged.withColumnRenamed("patch", "low"), F.col("patch") == F.col("id"), "left").select("grid_row", "grid_col", F.coalesce("low", "patch").alias("patch"))
