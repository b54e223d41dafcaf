"""Embedding near-duplicates by a pivot-permutation index, exactly.

Equal vectors of a label are one node. A node is described by its order of nearest reference points (pivots): the first
NEAREST of them, and all that could be among the first of a linked vector, for the distance of two linked vectors bounds
how far their orders can differ. The first pivots head the inverted lists: a node is at home in the list of its nearest one,
and a guest in the lists of those smaller ones in whose cell a linked vector may lie. In a list, homes meet homes and guests in
blocks: the pivots that a vector shares with what a group of neighbours allows are counted, and only vectors that share all
NEAREST are verified by their cosine. So no link is missed, and a pair meets once. Pivots keep a distance from each other, so
that a dense region has few. Links are counted where they are found: a task gives one row per linked node and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, join_hot, key_groups, small_side, staged
from .components import connected_components

#: Nodes of a block (on average), and bytes of their vectors. One pivot heads a list for every BLOCK nodes of the largest
#: label, up to MOST_LISTS; PIVOTS describe the vectors, and so many sampled vectors are looked at for each. Their number
#: changes the work, never the links.
BLOCK, BLOCK_BYTES, MOST_LISTS, PIVOTS, LOOKED_AT = 8192, 32 << 20, 256, 256, 4
#: Pivots of a description that must be shared, and vectors of a group of neighbours.
NEAREST, GROUP = 3, 128


def spread(sample: np.ndarray, wanted: int, reach: float) -> np.ndarray:
    """The first vectors of a sample that lie further than twice the reach of a link from those before, as many as wanted."""
    out = sample[:1]
    for v in sample[1:]:
        if len(out) == wanted:
            break
        if (((out - v) ** 2).sum(axis=1) > 4 * reach * reach).all():
            out = np.concatenate([out, v[None]])
    return out


def described(unit: np.ndarray, pivots: np.ndarray, reach: float, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivots of each vector, in order, and for each k which pivots a vector within reach may have among its first k.

    If p is among u's first k, one of v's first k, say q, is no nearer to u than p: u(q - p) <= 0, and so
    v(q - p) = u(q - p) + (v - u)(q - p) <= |v - u| |q - p|.
    """
    close = unit @ pivots.T
    order = np.argsort(-close, axis=1, kind="stable")[:, :nearest]
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))
    may = np.zeros((order.shape[1], *close.shape), bool)
    for k in range(order.shape[1]):
        q = order[:, k]
        may[k] = close[np.arange(len(unit)), q][:, None] - close <= reach * apart[q] + 1e-9
    return order, np.logical_or.accumulate(may)


def links(unit: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Each vector's links between two blocks, or within one, counting copies; a spanning forest of them; and the cosines taken.

    Products are taken in single precision; where that can't tell, in double.
    """
    n, within = len(unit), left is right
    nearest = min(NEAREST, len(pivots))
    order, may = described(unit, pivots, reach, nearest)
    left = left[np.lexsort(order[left].T[::-1])]  # neighbours have like orders
    right = left if within else right
    counts, component, edges, taken = np.zeros(n, np.int64), np.arange(n), [], 0
    single, doubt = unit.astype(np.float32), (unit.shape[1] + 2) * 2.0**-22
    rows, columns, orders, weight = single[left], single[right], order[right], copies.astype(float)
    for a in range(0, len(left), GROUP):
        some, first = left[a : a + GROUP], a if within else 0
        allowed = may[:, some].any(axis=1)
        shared = sum(allowed[k][orders[first:, k]].astype(np.int8) for k in range(nearest))
        kept = first + np.flatnonzero(shared == nearest)
        if 4 * len(kept) > 3 * (len(right) - first):  # a few more cosines cost less than to gather the vectors
            kept = slice(first, len(right))
        others = right[kept]
        taken += len(some) * len(others)
        close = rows[a : a + GROUP] @ columns[kept].T
        linked = close >= least
        i, j = np.nonzero(np.abs(close - least) <= doubt)
        for c in range(0, len(i), 65_536):
            x, y = i[c : c + 65_536], j[c : c + 65_536]
            linked[x, y] = (unit[some[x]] * unit[others[y]]).sum(axis=1) >= least
        if within:  # a pair inside the group counts once
            place = np.full(n, -1)
            place[some] = np.arange(len(some))
            linked &= ~((place[others][None, :] >= 0) & (place[others][None, :] <= np.arange(len(some))[:, None]))
        if not linked.any():
            continue
        told = linked.astype(float)
        counts[some] += np.rint(told @ weight[others]).astype(np.int64)
        counts[others] += np.rint(weight[some] @ told).astype(np.int64)
        for k in np.flatnonzero(linked.any(axis=1)).tolist():
            to = others[linked[k]]
            new = to[component[to] != component[some[k]]]
            if len(new):
                joined, first = np.unique(component[new], return_index=True)
                edges += [(int(some[k]), int(v)) for v in new[first]]
                component[np.isin(component, joined)] = component[some[k]]
    return counts, edges, taken


def _units(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Binaries of doubles as unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim, node, vector; node and vector are null in rows that link with nothing."""
    for batch in batches:
        ids, labels, lists = batch.columns
        dims, nodes, vectors = [], [], []
        for label, v in zip(labels.to_pylist(), lists, strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if label is not None and v.is_valid and len(v.values) and not v.values.null_count else None
            if x is None or not np.isfinite(x).all() or not x.any():
                dims.append(0), nodes.append(None), vectors.append(None)
                continue
            raw = (x + 0.0).astype("<f8").tobytes()
            dims.append(len(x))
            nodes.append(hashlib.blake2b(repr(label).encode() + b"\0" + raw, digest_size=16).digest())
            vectors.append(raw)
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "dim", "node", "vector"])


def near_vectors(table: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least that. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. component_id is the smallest vec_id reachable by links, the row's own included; null ids come last. Repeated
    rows are vectors of their own that link, as do all equal vectors of a label. An empty table gives an empty result.
    Very long vectors make blocks smaller. Further columns are not read.
    """
    kind = dict(table.dtypes)["label"]
    read = table.select("vec_id", "label", "embedding").mapInArrow(_read, f"vec_id long, label {kind}, dim int, node binary, vector binary")
    read = staged(read, "vectors")
    nodes = read.where("node is not null").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("label", "dim", "vector")], F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    nodes = staged(nodes, "nodes")
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    headed, reach = int(min(MOST_LISTS, max(1, most // BLOCK))), math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    sample = nodes.select("dim", "vector", F.xxhash64("node", F.lit(9)).alias("h")).orderBy("h", "vector").limit(PIVOTS * LOOKED_AT)
    sampled: dict[int, list] = {}
    for r in sample.collect():
        sampled.setdefault(r.dim, []).append(bytes(r.vector))
    known = {dim: spread(_units(pa.array(v, pa.binary()), dim), PIVOTS, reach) for dim, v in sampled.items()}
    pivots_of = lambda dim: known.get(dim, np.eye(1, dim))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                home, may = described(_units(part.column(3), dim), pivots_of(dim)[:headed], reach, 1)
                guest = may[0] & (np.arange(may.shape[2]) < home)
                found = pa.array([[h, *np.flatnonzero(g).tolist()] for h, g in zip(home[:, 0].tolist(), guest, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "lists"])

    entries = nodes.select("node", "label", "dim", "vector", "copies").mapInArrow(lists, f"node binary, label {kind}, dim int, vector binary, copies long, lists array<int>")
    # The first list is the node's home.
    heads = staged(entries.select("label", "dim", "lists", "node"), "lists").select("label", "dim", F.posexplode("lists").alias("place", "pivot"))
    in_block = F.least(F.lit(BLOCK), F.greatest(F.lit(256), F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    blocks = lambda rows: F.ceil(F.count_if(rows) / F.any_value(in_block)).cast("int")
    sizes = heads.groupBy("label", "dim", "pivot").agg(blocks(F.col("place") == 0).alias("homes"), blocks(F.col("place") > 0).alias("guests")).where("homes > 0")
    cut = entries.select("node", "label", "dim", "vector", "copies", F.posexplode("lists").alias("place", "pivot")).join(small_side(sizes, 64), ["label", "dim", "pivot"])
    h = F.xxhash64("node")
    cut = cut.withColumn("block", F.when(F.col("place") == 0, F.pmod(h, F.col("homes"))).otherwise(F.col("homes") + F.pmod(h, F.col("guests"))).cast("int"))
    last = F.when(F.col("place") == 0, F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.select("label", "dim", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "vector")
    keys = ["label", "dim", "pivot", "low", "high"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, keys):
            block, low, high, dim = group["block"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py(), group["dim"][0].as_py()
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            if not len(left) or not len(right):
                continue
            counts, edges, _ = links(_units(group["vector"], dim), group["copies"].to_numpy(), left, right, least, pivots_of(dim), reach)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            node = np.frombuffer(b"".join(group["node"].to_pylist()), np.uint8).reshape(-1, 16)
            ends = np.array(edges, np.int64).reshape(-1, 2)
            b = pa.concat_arrays([pa.nulls(len(some), pa.binary()), binaries(node[ends[:, 1]])])
            yield pa.RecordBatch.from_arrays([binaries(node[np.r_[some, ends[:, 0]]]), b, pa.array(np.r_[counts[some], np.zeros(len(ends), np.int64)])], ["a", "b", "links"])

    found = staged(cut.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(verify, "a binary, b binary, links long"), "links")

    classes = staged(connected_components(found.where("b is not null"), "a", "b"), "classes")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    linked = staged(classes.join(nodes.select("node", "copies", "rep"), "node").join(counts, "node"), "linked")
    smallest = staged(linked.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "smallest")
    member = join_hot(linked, smallest, "root", "n").select("node", "copies", "others", "component")
    equal = nodes.where("copies > 1").join(classes, "node", "left_anti").select("node", "copies", F.lit(0).cast("long").alias("others"), F.col("rep").alias("component"))
    member = staged(member.unionByName(equal).withColumn("n_links", F.col("others") + F.col("copies") - 1).drop("others"), "members")
    out = join_hot(read.select("vec_id", "node"), member, "node", "copies", "left", 120)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
