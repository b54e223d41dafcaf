"""Word shingles and MinHash signatures of Arrow text columns, vectorised with numpy.

A batch of texts is hashed as one byte buffer: no Python loop runs over words, only one over documents.
Words are the runs of bytes outside ASCII white space (0x20 and 0x09-0x0D), with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
#: Bytes hashed at once: a worker keeps two powers of 8 bytes for each, and some running sums while it hashes.
_BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse, grown as longer buffers come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) <= n:
            m = max(n + 1, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    x = np.full(m, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.multiply.accumulate(x))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the buffer, and the offsets of each row's words."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(raw)]
    first[bounds] = word[bounds]  # a row's start starts a word too
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    stops = np.empty_like(starts)
    blank = np.flatnonzero(~word)
    at = np.searchsorted(blank, starts)
    stops[:] = np.append(blank, len(raw))[at]
    stops[:-1] = np.minimum(stops[:-1], starts[1:])
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(starts):  # blocks bound the memory of the running sums
            hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + _BLOCK, "right")))
            hi = min(hi, len(starts))
            a, b = int(starts[lo]), int(stops[hi - 1])
            _Powers.to(b - a)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[raw[a:b]] * _Powers.up[: b - a], out=sums[1:])
            s, e = starts[lo:hi] - a, stops[lo:hi] - a
            out[lo:hi] = _mix((sums[e] - sums[s]) * _Powers.down[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            lo = hi
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int):
    """For each row, the sorted distinct hashes of its shingles of that many words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    hashes, at = word_hashes(raw, offsets)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        if len(whole):
            for k in range(words):
                whole = _mix(whole * np.uint64(0xE7037ED1A0B428DB) + hashes[k : k + len(whole)] + np.uint64(k + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = int(b - a)
            if n >= words:
                yield np.unique(whole[a : b - words + 1])
            elif n:
                x = np.zeros(1, np.uint64)
                for k in range(n):
                    x = _mix(x * np.uint64(0xE7037ED1A0B428DB) + hashes[a + k : a + k + 1] + np.uint64(k + 1))
                yield _mix(x + np.uint64(n << 32))
            else:
                yield np.zeros(0, np.uint64)


class MinHasher:
    """Signatures of `size` 32-bit minima; multiply-shift over the halves of the 64-bit hashes."""

    def __init__(self, size: int, seed: int = 20240229):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint64).astype(np.uint32)
        self.size = size

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 2048):
                x = low[None, i : i + 2048] * self.a
                x ^= x >> np.uint32(15)
                x += high[None, i : i + 2048]
                x *= self.a
                x ^= self.b
                np.minimum(out, x.min(axis=1), out=out)
        return out
