"""Mixing sources to target weights by the cube method.

A source's documents are each taken floor(target / size) times, and once more with the fraction that is left as inclusion
probability. The flight phase moves these probabilities through the null space of the balancing constraints (token total
and document count), in chunks of a source; what stays fractional, a few documents a chunk, is gathered and flown
again until a source has one chunk. The landing phase settles the last two so that the tokens come nearest the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_groups, small_side, staged

#: Documents of a chunk on average.
CHUNK = 4096
#: Sources weigh so, in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a chunk that are held back for the landing.
HELD = 10
_EDGE = 1e-9


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities, keeping sum(p) and sum(p * size), until at most HELD + 2 are neither 0 nor 1."""
    p = p.copy()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    s, q = size.astype(float).tolist(), p.tolist()
    hand: list[int] = []
    moving = [i for i in np.argsort(-size, kind="stable").tolist() if _EDGE < q[i] < 1 - _EDGE]
    held: set[int] = set()
    for k in range(1, min(HELD, len(moving)) + 1):  # sizes that halve, whose sums come near any number
        free = [i for i in moving[1:] if i not in held]
        if free:
            held.add(min(free, key=lambda i: abs(s[i] - s[moving[0]] / 2**k)))
    waiting = iter([i for i in moving if i not in held])
    while True:
        while len(hand) < 3 and (i := next(waiting, None)) is not None:
            hand.append(i)
        if len(hand) == 3:
            i, j, k = hand
            u = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and s[hand[0]] == s[hand[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min((1 - q[i]) / x if x > 0 else q[i] / -x for i, x in zip(hand, u, strict=True) if x)
        down = min(q[i] / x if x > 0 else (1 - q[i]) / -x for i, x in zip(hand, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(hand, u, strict=True):
            q[i] += step * x
        rest = [i for i in hand if _EDGE < q[i] < 1 - _EDGE]
        if len(rest) == len(hand):  # rounding: settle the one nearest an end
            rest.remove(min(rest, key=lambda i: min(q[i], 1 - q[i])))
        for i in set(hand) - set(rest):
            q[i] = float(round(q[i]))
        hand = rest
    return np.array(q)


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Settle the few fractional units so that their tokens, then their number, come nearest to what p promises."""
    p = p.copy()
    units = np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    tokens = np.abs(choices @ size[units] - p[units] @ size[units])
    count = np.abs(choices.sum(axis=1) - p[units].sum())
    p[units] = choices[np.argmin(tokens + 0.02 * size.mean() * count)]
    return np.rint(p)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, documents, target of each source, from rows (source, size).

    Targets are the sources' weights' parts of share * all sizes, none above most times its source's size: sources are
    capped in the order of capacity per weight, each cap raising the level of the rest.
    """
    stats = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    cap = most * F.col("source_size")
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = stats.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - before) / F.sum("weight").over(after.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    free = F.coalesce(F.max(F.when(~F.col("capped"), F.col("level"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free)
    return leveled.select("source", "source_size", "documents", target.alias("target"))


def _fly(seed: int, last: bool):
    """Flight of sorted chunks; `last`: a source's only chunk, whose rest lands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["source", "chunk"]):
            size, p = group["size"].to_numpy(), group["p"].to_numpy()
            name = group["source"][0].as_py()
            key = [seed, int(group["chunk"][0].as_py()), *(name.encode() if name is not None else [256]), len(size)]
            out = flight(size, p, np.random.Generator(np.random.PCG64(key)))
            if last:
                out = landing(size, out)
            at = group.schema.get_field_index("p")
            yield from group.set_column(at, "p", pa.array(out)).combine_chunks().to_batches()

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (taken = copies * size).

    key: a further column to carry, e.g. one that tells rows of equal doc_id apart. Null and empty texts have size 0 and
    take no words; the null source is a source, the last one. Ties and repeated rows are documents like others: chunks are
    ordered by doc_id, size and key, so reruns agree. If no text has words, all targets are 0. An empty table gives an
    empty result. Further columns are not read.
    """
    extra = [key] if key else []
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *extra)
    sizes = staged(sizes, "sizes")
    targets = staged(source_targets(sizes, weights, share, most), "targets")
    side = small_side(targets.withColumnRenamed("source", "of"), 160)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    rows = rows.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))
    rows = rows.withColumn("chunks", F.ceil(F.col("documents") / CHUNK))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", *extra), F.col("chunks")))
    order = ["source", "chunk", "doc_id", "size", *extra]

    def flown(df: DataFrame, level: int, last: bool) -> DataFrame:
        return df.repartition("source", "chunk").sortWithinPartitions(*order).mapInArrow(_fly(seed + level, last), df.schema)

    level = 0
    first = staged(flown(rows, level, False), "flight")
    is_open = (F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)
    done, rest = first.where(~is_open), first.where(is_open)
    while rest.agg(F.max("chunks")).first()[0] not in (None, 1):
        level += 1
        rest = rest.withColumn("chunks", F.ceil(F.col("chunks") * (HELD + 2) / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", *extra), F.col("chunks")))
        again = staged(flown(rest, level, False), "flight")
        done, rest = done.unionByName(again.where(~is_open)), again.where(is_open)
    landed = flown(rest.withColumn("chunk", F.lit(0).cast("long")), level + 1, True)
    copies = (F.col("base") + F.rint("p")).cast("long")
    return done.unionByName(landed).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *extra)
