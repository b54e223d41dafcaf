"""Vector best-fit packing of tokenized documents into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces
are placed longest first; the sequence is chosen under every constraint by the smallest weighted norm of what would be
left ("norm") or by the largest weighted dot product of the piece's and the sequence's residual vectors ("dot").
Pieces are dealt by a hash into as many groups as their number asks for, and each group is packed on its own: a group
wastes at most the last few sequences that it opens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import key_groups, slices, staged

#: Pieces of a group; a group is packed by one task.
GROUP = 16_384


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] | None = None, rule: str = "norm") -> np.ndarray:
    """The bin of each piece. Pieces of the whole token capacity or more have a bin of their own.

    Without weights, a capacity weighs as much as it is asked for on average.
    """
    caps = np.array(capacity, float)
    size = lengths.astype(float)
    need = np.stack([size, np.ones(len(size)), size * size], axis=1) / caps
    bins = np.empty(len(size), np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = order[lengths[order] >= capacity[0]]
    bins[whole] = np.arange(len(whole))
    rest = order[len(whole) :]
    if not len(rest):
        return bins
    smallest = need[rest].min(axis=0)
    left = np.ones((len(rest), 3))
    names = np.empty(len(rest), np.int64)
    w = np.array(weights) if weights else need[rest].mean(axis=0) / need[rest].mean(axis=0).max()
    slack, opened, used = 1e-12, 0, len(whole)
    for i in rest.tolist():
        x = need[i]
        at = -1
        if opened:
            after = left[:opened] - x
            fits = (after >= -slack).all(axis=1)
            if fits.any():
                score = (after * after) @ w if rule == "norm" else -(left[:opened] * x) @ w
                score[~fits] = np.inf
                at = int(np.argmin(score))
        if at < 0:
            at = opened
            left[at], names[at] = 1.0, used
            opened, used = opened + 1, used + 1
        left[at] -= x
        bins[i] = names[at]
        if (left[at] < smallest - slack).any():  # full: no piece fits any more
            opened -= 1
            left[at], names[at] = left[opened], names[opened]
    return bins


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut at that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, most_docs: int | None = None, most_cost: int | None = None, weights: tuple[float, float, float] | None = None, rule: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Without most_docs and most_cost, those two capacities are as large as a sequence can need, and only choose.
    Texts of any length count whole. Of pieces of one length the order is that of their ids, and of bins that fit equally well
    the first is taken. A null or empty text is one piece that holds the end id. Repeated rows are packed as often as they come; a null doc_id
    is carried along. An empty table gives an empty result; further columns are not read.
    """
    pieces = staged(tokenized_pieces(docs, tokenizer, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    capacity = (length, most_docs or length, most_cost or length * length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["group"]):
            sizes = group["length"].to_numpy()
            bins = vector_best_fit(sizes, capacity, weights, rule)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[order])
            first = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
            offsets = np.empty(len(sizes), np.int64)
            offsets[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(sizes)]))
            out = group.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + (group["group"][0].as_py() << 32))).append_column("offset", pa.array(offsets))
            yield from out.combine_chunks().to_batches()

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
