"""CRC-32 of many byte ranges at once: the table step runs over all ranges, one byte position a time."""

from __future__ import annotations

import zlib

import numpy as np

# ranges beyond this many bytes go through zlib one by one
LONG = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _table()


def crc32_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | int = 0) -> np.ndarray:
    """Unsigned crc32 of raw[start:end] for every range; ``before`` is the crc32 of bytes that precede each."""
    size = end - start
    crc = np.broadcast_to(np.asarray(before, np.uint32), size.shape) ^ np.uint32(0xFFFFFFFF)
    crc = crc.copy()
    # longest first, so the ranges that still have a byte at a position are the first ones
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, left, state = start[order], size[order], crc[order]
    skip = int((left > LONG).sum())
    at, left, state = at[skip:], left[skip:], state[skip:]
    many = np.bincount(left, minlength=1) if len(left) else np.zeros(1, np.int64)
    live = len(left)
    for k in range(len(many) - 1):
        live -= int(many[k])
        state[:live] = _TABLE[(state[:live] ^ raw[at[:live] + k]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    crc[order[skip:]] = state
    out = crc ^ np.uint32(0xFFFFFFFF)
    if skip:
        given = np.broadcast_to(np.asarray(before, np.uint32), size.shape)
        for i in order[:skip].tolist():
            out[i] = zlib.crc32(raw[start[i]:end[i]].tobytes(), int(given[i]))
    return out
