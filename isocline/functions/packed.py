"""Binary pages of a grid and half-precision changes, for exchange with readers of such files."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

#: Cells along a page's side, and the value of a cell that has none.
SIDE, NONE = 256, -32768


def pack_page(slots: np.ndarray, values: np.ndarray, scale: float = 1.0) -> bytes:
    """A page of 16-bit values at cell numbers: a header's length, the header, then deflated byte planes of row differences."""
    grid = np.full((SIDE, SIDE), NONE, np.int16)
    grid.reshape(-1)[slots] = values
    steps = np.diff(grid.astype(np.int32), axis=0, prepend=np.zeros((1, SIDE), np.int32)).astype(np.uint16)
    planes = np.stack([steps & 0xFF, steps >> 8]).astype(np.uint8).tobytes()
    header = json.dumps({"side": SIDE, "scale": scale, "none": NONE}).encode()
    header += b" " * (-len(header) % 4)
    return struct.pack("<I", len(header)) + header + zlib.compress(planes, 6)


def unpack_page(page: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cell numbers that have values, and the scaled values."""
    (size,) = struct.unpack_from("<I", page)
    header = json.loads(page[4 : 4 + size])
    low, high = np.frombuffer(zlib.decompress(page[4 + size :]), np.uint8).reshape(2, header["side"], header["side"]).astype(np.uint16)
    grid = np.cumsum(low | (high << 8), axis=0, dtype=np.uint16).view(np.int16).reshape(-1)
    slots = np.flatnonzero(grid != header["none"])
    return slots, grid[slots] * header["scale"]


def halves(values: np.ndarray) -> np.ndarray:
    """Values as half-precision numbers have them; those beyond its range are infinite."""
    with np.errstate(over="ignore"):
        return np.asarray(values, np.float64).astype(np.float16).astype(np.float64)
