"""What the operators share: stage tables in the cluster's shared folder, sized joins and grouped Arrow streams."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many bytes are broadcast; their rows are counted first.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it has more rows than the first, and more than one in the second of all.
HOT_ROWS, HOT_KEYS = 64, 50_000
#: Texts are handled in slices of about so many bytes, whatever the size of Arrow's batches.
SLICE_BYTES = 2 << 20
_STAGED: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; where that is unset, a temporary one of a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="isocline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table to the shared folder and read again: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._isocline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _STAGED.remove(path)


def unstage(df: DataFrame) -> None:
    """Delete a table of staged() that no later plan reads."""
    _delete(df.sparkSession, df._isocline_path)


def clear_stages(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the stage tables of this driver but keep's, or those since a stage_mark(), once no unfinished plan reads them."""
    for path in _STAGED[since:]:
        if keep is None or path != keep._isocline_path:
            _delete(spark, path)


def stage_mark() -> int:
    """How many stage tables this driver has."""
    return len(_STAGED)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df doesn't have, in any case of letters."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast only if its counted rows, of row_bytes each in a hashed relation, fit the bound; else Spark shuffles, and AQE splits hot keys."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, how: str = "inner", row_bytes: int = 0) -> DataFrame:
    """rows joined ("inner" or "left") with side by key; side has one row per key and in column `count`, which goes, how many rows it meets.

    With row_bytes, side is broadcast whole if its counted rows fit the bound. Else keys with more than their share of the
    rows are hot, at most HOT_KEYS, whatever the size: their side is broadcast, so that their rows stay in their
    partitions, and all others are joined by a shuffle. Both tables should be staged. Null keys meet nothing.
    """
    n, total, most = side.agg(F.count("*"), F.sum(count), F.max(count)).first()
    if row_bytes and n * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side.drop(count)), key, how)
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    is_hot = F.col(count) > least
    hot, cold = F.broadcast(side.where(is_hot).drop(count)), side.where(~is_hot).drop(count)
    parts = [rows.where(F.col(key).isNull())] if how == "left" else []
    if n and most > least:
        parts += [rows.join(hot, key)]
        rows = rows.join(F.broadcast(side.where(is_hot).select(key)), key, "left_anti")
    out = rows.where(F.col(key).isNotNull()).join(cold, key, how)
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def key_field(df: DataFrame, key: str | None) -> str:
    """The end of a schema that carries a key column along."""
    return f", {key} {dict(df.dtypes)[key]}" if key else ""


def hand_back() -> None:
    """Give this worker's free memory back to the system; Arrow's pool and the C library else keep the most that any task took, until the worker ends."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def handing_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; free memory goes back to the system behind each large one, and at the end."""
    for batch in batches:
        large = batch.nbytes > SLICE_BYTES
        yield batch
        del batch
        if large:
            hand_back()
    hand_back()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about SLICE_BYTES of the text column."""
    for batch in handing_back(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of a stream that is sorted by them; one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in handing_back(batches):
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k))
            if len(c) > 1:
                change[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                change[1:] |= pc.is_null(c.slice(1)).to_numpy(zero_copy_only=False) != pc.is_null(c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = tuple(batch.column(batch.schema.get_field_index(k))[a].as_py() for k in keys)
            if held and first != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = first
    if held:
        yield pa.concat_tables(held)


def fixed_binary(column: pa.ChunkedArray | pa.Array, width: int, dtype) -> np.ndarray:
    """A column of equally long binaries without nulls as a matrix."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        c = c.cast(pa.large_binary())
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, c.offset * 8)
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    raw = np.ascontiguousarray(np.concatenate(parts)) if parts else np.zeros(0, np.uint8)
    return raw.view(dtype).reshape(-1, width)


def binaries(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a column of binaries, one for each row."""
    rows = np.ascontiguousarray(rows, np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
