"""MinHash near-duplicates by an LSH forest.

Each tree sorts the signatures by a rotation of their values; all trees are one table of keys, sorted over all
partitions, so that a crowded region is many tasks' work. Rows whose longest common prefix with a neighbour has DEPTH
values form a region. A region of more than REGION rows is deepened: it is cut where neighbours share least, and each cut, like
each border of two partitions, is bridged by OVERLAP rows. The rows of a run yield a spanning forest of pairs whose
signatures agree often enough, its components are candidates for each other, and links are confirmed on the full shingle
sets inside blocks of a component. No step emits all pairs of a group, and exact copies are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import binaries, fixed_binary, handing_back, join_hot, key_field, key_groups, slices, small_side, staged
from .components import connected_components, contracted

SIZE, DEPTH, TREES = 128, 4, 32
#: Values beyond DEPTH, of 16 bits each, that a key sorts by.
DEEPER = 8
#: Rows of a run, and rows that bridge a cut.
REGION, OVERLAP = 1024, 64
#: Different texts of a block, and bytes of their sets (both on average).
BLOCK, BLOCK_BYTES = 768, 8 << 20
#: Pairs are candidates if their signatures agree in at least this share less than the wanted similarity: 5 deviations.
SLACK = 0.18
_REGION_KEY, _KEY, _NODE = 9, 9 + 2 * DEEPER, 16


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.MinHasher(SIZE)
        for batch in slices(batches):
            raw, offsets = shingles.text_buffers(batch.column(1))
            n, digests, signatures = [], [], []
            for x in shingles.shingle_sets(raw, offsets, words):
                n.append(len(x))
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                signatures.append(hasher.signature(x).astype(">u4").tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), *batch.columns[2:]], ["doc_id", "n_shingles", "node", "signature", *batch.schema.names[2:]])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a node in all trees: tree, a hash of its first DEPTH values there, and the DEEPER values that follow."""
    for batch in handing_back(batches):
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            values = fixed_binary(part.column(1), SIZE, ">u4").astype(np.uint64)
            nodes = fixed_binary(part.column(0), _NODE, np.uint8)
            keys = np.empty((TREES, len(values), _KEY), np.uint8)
            for t in range(TREES):
                turned = np.roll(values, -DEPTH * t, axis=1)
                region = np.full(len(values), t + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(DEPTH):
                        region = shingles._mix(region * np.uint64(0xE7037ED1A0B428DB) + turned[:, k])
                keys[t, :, 0] = t
                keys[t, :, 1:_REGION_KEY] = region.astype(">u8").view(np.uint8).reshape(len(values), 8)
                deeper = np.ascontiguousarray((turned[:, DEPTH : DEPTH + DEEPER] & np.uint64(0xFFFF)).astype(">u2"))
                keys[t, :, _REGION_KEY:] = deeper.view(np.uint8).reshape(len(values), 2 * DEEPER)
            yield pa.RecordBatch.from_arrays([binaries(keys.reshape(-1, _KEY)), binaries(np.tile(nodes, (TREES, 1)))], ["key", "node"])


def common_prefix(keys: np.ndarray) -> np.ndarray:
    """How many values beyond DEPTH each of the sorted keys shares with the one before, -1 in another region."""
    out = np.full(len(keys), -1)
    same = keys[1:] == keys[:-1]
    pairs = same[:, _REGION_KEY::2] & same[:, _REGION_KEY + 1 :: 2]
    shared = np.cumprod(pairs, axis=1).sum(axis=1)
    out[1:] = np.where(same[:, :_REGION_KEY].all(axis=1), shared, -1)
    return out


def deepened(shared: np.ndarray, start: int, stop: int, last: bool) -> tuple[list[tuple[int, int]], int]:
    """Runs (from, to) of a sorted region, and where the rest begins if more of it may follow (last: nothing does)."""
    runs = []
    while stop - start > (REGION if last else REGION + OVERLAP):
        some = shared[start + REGION // 2 : start + REGION + 1]
        cut = start + REGION // 2 + int(len(some) - 1 - np.argmin(some[::-1]))
        runs.append((start, min(cut + OVERLAP, stop)))
        start = cut
    if last:
        runs.append((start, stop))
    return runs, start


_RUNS = "pid int, run long, node binary, key binary, tail boolean"


def _rows(pid: int, run: np.ndarray, nodes: np.ndarray, keys: np.ndarray | None = None, tail: bool | None = None) -> pa.RecordBatch:
    n = len(nodes)
    told = binaries(keys) if keys is not None else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(run), binaries(nodes), told, pa.array([tail] * n, pa.bool_())], ["pid", "run", "node", "key", "tail"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a partition's sorted keys with the rows of each, and the rows at its borders with their keys."""
    pid, run = TaskContext.get().partitionId(), 0
    keys, nodes = np.zeros((0, _KEY), np.uint8), np.zeros((0, _NODE), np.uint8)
    head = tail = None

    def found(last: bool) -> tuple[list[pa.RecordBatch], int]:
        nonlocal run
        shared = common_prefix(keys)
        starts = np.flatnonzero(shared < 0)
        stops = np.r_[starts[1:], len(keys)]
        ready = stops if last else stops[:-1]
        sizes = ready - starts[: len(ready)]
        small = (sizes > 1) & (sizes <= REGION)
        counts = sizes[small]
        index = np.repeat(starts[: len(ready)][small] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)
        out = [_rows(pid, run + np.repeat(np.arange(len(counts)), counts), nodes[index])] if len(index) else []
        run += len(counts)
        for k in np.flatnonzero(sizes > REGION).tolist():
            for a, b in deepened(shared, int(starts[k]), int(stops[k]), True)[0]:
                out.append(_rows(pid, np.full(b - a, run), nodes[a:b]))
                run += 1
        rest = len(keys)
        if not last and len(starts):
            cut, rest = deepened(shared, int(starts[-1]), len(keys), False)
            for a, b in cut:
                out.append(_rows(pid, np.full(b - a, run), nodes[a:b]))
                run += 1
        return out, rest

    for batch in handing_back(batches):
        if not batch.num_rows:
            continue
        new_keys, new_nodes = fixed_binary(batch.column(0), _KEY, np.uint8), fixed_binary(batch.column(1), _NODE, np.uint8)
        if head is None or len(head[0]) < OVERLAP:
            more = (new_keys[:OVERLAP], new_nodes[:OVERLAP])
            head = more if head is None else tuple(np.concatenate([x, y])[:OVERLAP] for x, y in zip(head, more, strict=True))
        ends = (new_keys[-OVERLAP:], new_nodes[-OVERLAP:])
        tail = ends if tail is None else tuple(np.concatenate([x, y])[-OVERLAP:] for x, y in zip(tail, ends, strict=True))
        keys, nodes = np.concatenate([keys, new_keys]), np.concatenate([nodes, new_nodes])
        out, rest = found(False)
        yield from out
        keys, nodes = keys[rest:], nodes[rest:]
    if len(keys):
        yield from found(True)[0]
    if head is not None:
        for part, at_end in ((head, False), (tail, True)):
            yield _rows(pid, np.full(len(part[0]), -1), part[1], part[0], at_end)


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions that a border of two partitions cuts, as runs of their own."""
    for group in key_groups(batches, ["border"]):
        keys, nodes = fixed_binary(group["key"], _KEY, np.uint8), fixed_binary(group["node"], _NODE, np.uint8)
        tail = group["tail"].to_numpy()
        starts = np.flatnonzero(common_prefix(keys) < 0)
        for k, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(keys)], strict=True)):
            if tail[a:b].any() and not tail[a:b].all():
                yield _rows(-1 - group["border"][0].as_py(), np.full(b - a, k), nodes[a:b])


def _spanning(same: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximal spanning forest of the pairs that agree at least so often (Prim's algorithm)."""
    n = len(same)
    best, link, out = np.full(n, -1.0), np.zeros(n, np.int64), []
    todo = np.ones(n, bool)
    at = 0
    for _ in range(n):
        todo[at] = False
        row = (same == same[at]).mean(axis=1) if n > 1 else best
        better = todo & (row > best)
        best[better], link[better] = row[better], at
        if not todo.any():
            break
        at = int(np.argmax(np.where(todo, best, -2.0)))
        if best[at] >= least:
            out.append((int(link[at]), at))
    return out


def _candidates(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["pid", "run"]):
            nodes = fixed_binary(group["node"], _NODE, np.uint8)
            pairs = _spanning(fixed_binary(group["signature"], SIZE, np.uint32), least)
            if pairs:
                ends = np.array(pairs)
                yield pa.RecordBatch.from_arrays([binaries(nodes[ends[:, 0]]), binaries(nodes[ends[:, 1]])], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = shingles.text_buffers(batch.column(1))
            found = [x.tobytes() for x in shingles.shingle_sets(raw, offsets, words)]
            nodes = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "node", "shingles"])

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["loose", "low", "high"]):
            nodes, n = group["node"].to_pylist(), group.num_rows
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in group["shingles"].chunks for x in c]
            sizes = np.array([len(x) for x in sets])
            ends = np.cumsum(sizes)
            _, index = np.unique(np.concatenate(sets), return_inverse=True)
            lists = np.split(index.astype(np.int32), ends[:-1])
            marks = np.zeros(int(index.max()) + 1, bool)
            root = np.arange(n)
            found: list[tuple[bytes, bytes]] = []
            for i in range(n):
                ahead = np.arange(i + 1, n)
                ahead = ahead[root[ahead] != root[i]]
                ahead = ahead[100 * np.minimum(sizes[ahead], sizes[i]) >= percent * np.maximum(sizes[ahead], sizes[i])]
                if not len(ahead):
                    continue
                marks[lists[i]] = True
                for k in range(0, len(ahead), 256):
                    some = ahead[k : k + 256]
                    some = some[root[some] != root[i]]
                    if not len(some):
                        continue
                    shared = np.add.reduceat(marks[np.concatenate([lists[j] for j in some])], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
                    for j in some[100 * shared >= percent * (sizes[some] + sizes[i] - shared)].tolist():
                        if root[j] != root[i]:
                            root[root == root[j]] = root[i]
                            found.append((nodes[i], nodes[j]))
                marks[lists[i]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return run


def _runs(nodes: DataFrame) -> DataFrame:
    """(pid, run, node): the runs of all trees, named by pid and run."""
    keys = nodes.select("node", "signature").mapInArrow(_keys, "key binary, node binary")
    walked = staged(keys.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_regions, _RUNS), "runs")
    edges = walked.where("key is not null")
    order = {r.pid: k for k, r in enumerate(edges.select("pid").distinct().orderBy("pid").collect())}  # one number a partition

    def bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            border = [order[p] - (not t) for p, t in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(border, pa.int32()), *batch.columns], ["border", *batch.schema.names])

    near = edges.mapInArrow(bordered, f"border int, {_RUNS}").repartition("border").sortWithinPartitions("border", "key", "node")
    names = ["pid", "run", "node"]
    return walked.where("key is null").select(*names).unionByName(near.mapInArrow(_bridges, _RUNS).select(*names))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * intersection >= percent * union of their sets of distinct word shingles; component_id is the
    smallest doc_id reachable by links. Texts without words, and null texts, link with nothing and are their own
    component. Texts with fewer words than a shingle have their whole sequence as the one shingle. Texts of any length
    count whole: blocks are bounded by the bytes of their sets, and a set larger than that is alone with another. Repeated
    rows are exact copies and share a component; a null doc_id is larger than any other, and kept only if its component
    has no other. An empty table gives an empty result. key is a further column to carry; others are not read.
    """
    least = percent / 100 - SLACK
    text = docs.select("doc_id", "text")
    extra = [key] if key else []
    base = staged(docs.select("doc_id", "text", *extra).mapInArrow(_signatures(words), f"doc_id long, n_shingles long, node binary, signature binary{key_field(docs, key)}"), "signatures")
    nodes = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("size"), F.any_value("signature").alias("signature"))
    nodes = staged(nodes, "nodes")

    runs = _runs(nodes).join(nodes.select("node", "signature"), "node").repartition("pid", "run").sortWithinPartitions("pid", "run", "node")
    find = _candidates(least)
    loose = connected_components(runs.mapInArrow(lambda batches: contracted(find(batches)), "u binary, v binary"), "u", "v", chunked=True)
    loose = staged(loose.join(nodes.select("node", "rep", "size"), "node"), "loose")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("size") / BLOCK_BYTES)).cast("int")
    size = staged(loose.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")), "sizes")
    wanted = staged(join_hot(loose, size, "root", "n").select(F.col("root").alias("loose"), "node", "rep", "blocks"), "wanted")
    asked = small_side(wanted.select(F.col("rep").alias("doc_id")).distinct(), 64)
    sets = text.join(asked, text.doc_id.eqNullSafe(asked.doc_id), "left_semi").mapInArrow(_sets(words), "doc_id long, node binary, shingles binary")
    sets = sets.join(small_side(wanted, 200), "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("loose", "node", "blocks", "shingles")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("loose", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "shingles")
    sets = sets.repartition("loose", "low", "high").sortWithinPartitions("loose", "low", "high", "node")
    verify = _links(percent)
    classes = staged(connected_components(sets.mapInArrow(lambda batches: contracted(verify(batches)), "u binary, v binary"), "u", "v", chunked=True), "classes")

    # Only documents with copies or links need a look-up; all others are their own component.
    linked = staged(classes.join(nodes.select("node", "rep", "copies"), "node"), "linked")
    lowest = staged(linked.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "lowest")
    member = join_hot(linked, lowest, "root", "n").select("node", "component", "copies")
    copied = nodes.where("copies > 1").join(classes, "node", "left_anti").select("node", F.col("rep").alias("component"), "copies")
    member = staged(member.unionByName(copied).withColumn("found", F.lit(True)), "members")
    out = join_hot(base.select("doc_id", "n_shingles", "node", *extra), member, "node", "copies", "left", 120)
    component = F.when(F.col("found"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *extra)
