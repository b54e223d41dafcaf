"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are first contracted chunk by chunk: a chunk of bounded size becomes a star of each of its components. Then stars are
joined until each component is one. Minima are aggregated before they are shuffled, and the edges of a node that has many, such
as a star's centre, stay in their partitions: its minimum is sent to them (join_hot).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged, unstage

#: Edges of a chunk that one task contracts at once.
CHUNK = 1 << 16


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0 to n - 1 by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while not np.array_equal(shorter := new[new], new):
            new = shorter
        if np.array_equal(new, root):
            return root
        root = new


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each chunk as stars (u, v): every node with its chunk's smallest node that it reaches."""

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        nodes = pa.concat_arrays([c for k in (0, 1) for c in table.column(k).chunks])
        coded = nodes.dictionary_encode()
        names = coded.dictionary
        order = np.asarray(pc.sort_indices(names))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[np.asarray(coded.indices)]
        root = roots(ends[: len(table)], ends[len(table) :], len(order))
        some = np.flatnonzero(root != np.arange(len(order)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(order[some])), names.take(pa.array(order[root[some]]))], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield from stars(held)
            held, rows = [], 0
    if held:
        yield from stars(held)


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included, and its number of edges; edges: (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return join_hot(both, staged(_lowest(both), "lowest"), "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    low = staged(_lowest(edges), "lowest")
    return join_hot(edges, low, "u", "n").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges u > v are the stars of their components already: no node has two lower ends, or a lower end and a higher one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low = 1 and high = 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, left: str, right: str, chunked: bool = False) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    chunked: edges come from contracted() already, in the Python workers that found them. Nodes are binaries, strings or numbers. Loops, repeated edges and edges with a null end are allowed and change
    nothing. An empty table gives none.
    """
    kind = dict(edges.dtypes)[left]
    given = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    now = staged((given if chunked else given.mapInArrow(contracted, f"u {kind}, v {kind}")).distinct(), "edges")
    while not _stars(now):
        large = staged(_large_star(now).where("u <> v").distinct(), "edges")
        unstage(now)
        now = staged(_small_star(large).where("u <> v").distinct(), "edges")
        unstage(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
