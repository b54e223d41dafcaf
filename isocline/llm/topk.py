"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are dealt into bands of length, and bands into slices. All queries first meet a slice of the longest vectors, which
gives each a threshold: no band whose longest vector, times the query's own length, stays below it holds one of its best.
Queries with the same number of bands left make blocks, and a slice is sent only to blocks that need its band. A slice is
scanned bucket by bucket from the longest vectors on. A query's k-th score so far, over its length and the bucket's longest
vector, is its local cosine threshold: above 1 the bucket, and all shorter ones, are pruned; a high one prunes by the
feasible range of the query's heaviest coordinates, a lower one by length; what is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_groups, small_side, staged
from .vectors import finite, matrix, with_copies

#: Queries of a block, vectors of a slice (on average), vectors of a bucket.
QUERIES, SLICE, BUCKET = 4096, 16_384, 1024
#: Bands of length, at most: one for each slice.
BANDS = 64
#: Thresholds from which coordinates prune, and coordinates that are looked at.
STEEP, FOCUS = 0.6, 3
_NULL = np.iinfo(np.int64).max


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, by score and then the smaller id; sorted by query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < k]


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray | None = None):
    """(query index, vector index, score) of each query's k best vectors, its own row left out.

    known: scores of which each query has k as good elsewhere; what stays below them may be left out.
    own and rows name rows as (id, copy) pairs. Values are whole numbers; beyond 2**53 products are taken of Python's.
    """
    length, reach = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    if len(vectors) and len(queries) and length.max() * reach.max() >= 2.0**53:
        vectors, queries = (np.frompyfunc(int, 1, 1)(x) for x in (vectors, queries))
    order = np.argsort(-length, kind="stable")
    place = {(int(a), int(b)): i for i, (a, b) in enumerate(own)}
    least = np.full(len(queries), -np.inf) if known is None else known.astype(float)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype)]
    unit = queries / np.where(reach > 0, reach, 1.0)[:, None]
    heavy = np.argsort(-np.abs(unit.astype(float)), axis=1)[:, :FOCUS]
    for at in range(0, len(order), BUCKET):
        some = order[at : at + BUCKET]
        longest = length[some[0]]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach * longest > 0, least / (reach * longest), np.where(least > 0, 2.0, -np.inf))
        alive = np.flatnonzero(cosine <= 1 + 1e-9)
        if not len(alive):
            break
        block = vectors[some]
        steep = alive[cosine[alive] >= STEEP]
        flat = alive[cosine[alive] < STEEP]
        found = []
        if len(steep):  # by coordinates
            shares = block.astype(float) / np.where(length[some] > 0, length[some], 1.0)[:, None]
            t = np.minimum(cosine[steep], 1.0)
            mask = np.ones((len(steep), len(some)), bool)
            for f in range(FOCUS):
                c = heavy[steep, f]
                x = unit[steep, c].astype(float)
                half = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                low, high = np.where(x <= -t, -1.0, x * t - half), np.where(x >= t, 1.0, x * t + half)
                mask &= (shares[:, c].T >= low[:, None] - 1e-9) & (shares[:, c].T <= high[:, None] + 1e-9)
            i, j = np.nonzero(mask)
            found.append((steep[i], some[j], (queries[steep[i]] * block[j]).sum(axis=1)))
        if len(flat):  # by length: the bucket's vectors are sorted, so that a prefix is long enough
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(reach[flat] > 0, least[flat] / reach[flat], -np.inf)
            enough = int((length[some] >= need.min() - 1e-9).sum())
            products = queries[flat] @ block[:enough].T
            bar = least[flat].astype(products.dtype) if products.dtype != object else least[flat]
            if enough > k + 1 and products.dtype != object:
                bar = np.maximum(bar, np.partition(products, enough - k - 1, axis=1)[:, enough - k - 1])  # k and the query itself
            i, j = np.nonzero(products >= bar[:, None])
            found.append((flat[i], some[j], products[i, j]))
        q, v, s = (np.concatenate([held[c], *[x[c] for x in found]]) for c in range(3))
        mine = np.array([place.get((int(a), int(b)), -1) for a, b in rows[some]])
        where = np.full(len(vectors), -1)
        where[some] = mine
        keep = where[v] != q
        q, v, s = q[keep], v[keep], s[keep]
        best = _first(q, s, ids[v], k)
        held = [q[best], v[best], s[best]]
        counts = np.bincount(held[0], minlength=len(queries))
        full = np.flatnonzero(counts >= k)
        last = np.cumsum(counts) - 1
        least[full] = np.maximum(least[full], held[2][last[full]].astype(float))
    return held


def _longs(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond stand at the ends of the range."""
    if score.dtype != object:
        return score.astype(np.int64)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([min(high, max(low, int(s))) for s in score], np.int64)


def top_inner_products(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for every row whose vec_id is divisible by `every`.

    Components are floor(scale * x) of the double x, and scores integer inner products. Vectors that are null, empty, or
    hold null or non-finite components take no part; vectors of different lengths never meet. Components and
    scores beyond 64 bits stand at the ends of that range. Ties go to the smaller vec_id, null ids last. Of repeated rows each is a query and a candidate of the others. An empty table gives an empty
    result. Further columns are not read.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = with_copies(table.select("vec_id", "embedding").where(finite(F.col("embedding"))).select("vec_id", whole.alias("v")), "v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = staged(rows.select("vec_id", "copy", "v", F.size("v").alias("dim"), length.alias("length")), "vectors")

    # Bands from the longest vectors on; of one length there may be any number, so that a band has as many slices as it needs.
    wanted = min(BANDS, max(1, -(-rows.count() // SLICE)))
    cuts = rows.groupBy("dim").agg(F.percentile_approx("length", [1 - b / wanted for b in range(1, wanted)] or [0.0], 10_000).alias("cuts"))
    h = F.xxhash64("vec_id", "copy")
    in_band = rows.join(small_side(cuts, 1024), "dim") if wanted > 1 else rows.withColumn("cuts", F.array().cast("array<double>"))
    in_band = in_band.withColumn("band", F.size(F.filter("cuts", lambda c: F.col("length") < c))).drop("cuts")
    bands = staged(in_band.groupBy("dim", "band").agg(F.max("length").alias("longest"), F.ceil(F.count("*") / SLICE).cast("int").alias("parts")), "bands")
    placed = in_band.join(small_side(bands.select("dim", "band", "parts"), 64), ["dim", "band"]).withColumn("part", F.pmod(h, F.col("parts")).cast("int")).drop("parts")
    first = staged(bands.groupBy("dim").agg(F.min("band").alias("band"), F.sort_array(F.collect_list("longest"), False).alias("reach")), "reaches")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in key_groups(batches, keys):
                side = group["side"].to_numpy()
                q, c = side == 0, side == 1
                if not q.any() or not c.any():
                    continue
                v, ids, copies = matrix(group["v"]), group["vec_id"].fill_null(_NULL).to_numpy(), group["copy"].to_numpy().astype(np.int64)
                names = np.stack([ids, copies], axis=1)
                query, vector, score = search(v[q], names[q], v[c], ids[c], names[c], k, group["least"].to_numpy()[q])
                found = ids[c][vector]
                bars = np.nextafter(score.astype(float), -np.inf) if score.dtype == object else score.astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(names[q][query, 0]), pa.array(names[q][query, 1]), pa.array(found, pa.int64(), mask=found == _NULL), pa.array(_longs(score), pa.int64()), pa.array(bars)], ["query_id", "copy", "vec_id", "score", "exact"])

        keys = ["dim", "need", "block", "band", "part"]
        columns = [*keys, "side", "vec_id", "copy", "v", "least"]
        both = left.select(*columns).unionByName(right.select(*columns)).repartition(*keys).sortWithinPartitions(*keys, "side", "vec_id", "copy")
        return both.mapInArrow(run, "query_id long, copy long, vec_id long, score long, exact double")

    side = lambda n: F.lit(n).alias("side")
    none = F.lit(float("-inf")).alias("least")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    lead = small_side(first.select("dim", "band"), 64)
    left = asked.join(lead, "dim").select("dim", F.lit(0).alias("need"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"), "band", F.lit(0).alias("part"), side(0), "vec_id", "copy", "v", none)
    right = placed.where("part = 0").join(lead, ["dim", "band"]).select("dim", F.lit(0).alias("need"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "band", "part", side(1), "vec_id", "copy", "v", none)
    begun = staged(met(left, right), "begun")

    # What each query has k of, and the bands whose vectors can reach it.
    bar = begun.groupBy(F.col("query_id").alias("vec_id"), "copy").agg(F.when(F.count("*") >= k, F.min("exact")).otherwise(float("-inf")).alias("least"))
    need = F.size(F.filter("reach", lambda m: F.col("length") * m * (1 + 1e-9) + 1e-9 >= F.col("least")))
    todo = asked.join(bar, ["vec_id", "copy"], "left").fillna(float("-inf"), ["least"]).join(small_side(first.drop("band"), 1024), "dim").withColumn("need", need).drop("reach")
    todo = staged(todo, "asked")
    sizes = todo.groupBy("dim", "need").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    order = bands.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("band")))
    pairs = staged(sizes.join(order, "dim").where("place <= need").select("dim", "need", "blocks", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "pairs")
    pairs = pairs.join(first.select("dim", F.col("band").alias("lead")), "dim").where("not (band = lead and part = 0)").drop("lead")
    left = todo.join(small_side(pairs, 96), ["dim", "need"]).select("dim", "need", F.pmod(h, F.col("blocks")).cast("int").alias("block"), "band", "part", side(0), "vec_id", "copy", "v", "least")
    right = placed.join(small_side(pairs, 96), ["dim", "band", "part"]).select("dim", "need", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "band", "part", side(1), "vec_id", "copy", "v", none)
    best = begun.unionByName(met(left, right)).drop("exact")
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
