"""Vectorised text helpers that run inside Spark tasks (numpy over one Arrow batch at a time).

A batch of texts is concatenated into one byte array with one separator byte between texts;
words become 64-bit hashes with byte offsets, so rolling word windows are array arithmetic.
Two words are equal when their 64-bit hashes are: the hash is a position-free polynomial over
random 64-bit byte values with a final mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

U = np.uint64
# texts handed on at once, by bytes: a single longer text is one batch of its own
BATCH_BYTES = 1 << 20

_R = U(0x9E3779B97F4A7C15 | 1)
_RINV = U(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def _lut(is_sep) -> np.ndarray:
    out = np.zeros(256, bool)
    for b in range(256):
        out[b] = is_sep(b)
    return out


# byte classes that end a word
SPACE_SEP = _lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
ALNUM_SEP = _lut(lambda b: b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(32))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each.

    Tables of the usual batch size are kept in the worker; those of a few words (the driver's
    templates travel with the tasks) and of a very long text are not.
    """
    usual = BATCH_BYTES + 65536
    if 65536 < n <= usual and "p" in _pow_cache:
        return _pow_cache["p"], _pow_cache["q"]
    m = usual if 65536 < n <= usual else n
    p, q = np.full(m, _R, np.uint64), np.full(m, _RINV, np.uint64)
    p[:1] = q[:1] = 1
    p, q = np.cumprod(p), np.cumprod(q)
    if m == usual:
        _pow_cache["p"], _pow_cache["q"] = p, q
    return p, q


def to_bytes(text) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    if text is None or text is pd.NA or (isinstance(text, float) and text != text):
        return b""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def word_hashes(buf: bytes, sep: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, start byte, end byte) of the words of lower-cased ``buf``, in order.

    ``heads``: one more array each, the hash of the words' first so many bytes.
    """
    raw = LOWER[np.frombuffer(buf, np.uint8)]
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), z, z, *(np.zeros(0, np.uint64) for _ in heads))
    inside = np.empty(n + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(sep[raw], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, q = _powers(n)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum(_BYTE[raw] * p[:n], out=h[1:])
    first = [mix((h[np.minimum(end, start + c)] - h[start]) * q[start] + U(c << 32)) for c in heads]
    return mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64)), start, end, *first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` consecutive values; empty when there are fewer."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, k):
        out = mix(out * _R + h[j:j + m])
    return mix(out + U(k))


def window_min_positions(v: np.ndarray, w: int) -> np.ndarray:
    """Positions of the leftmost minimum of every window of ``w`` values (each once, ascending).

    Values are compared by their upper 40 bits, so equal windows choose the same place wherever they
    stand. Fewer than ``w`` values give one window. Block prefix/suffix minima: linear, no loop.
    """
    n = len(v)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    shift = U(24)
    most = 1 << 24
    if n > most:  # positions take 24 bits: longer texts go in overlapping parts
        step = most - w + 1
        return np.unique(np.concatenate([window_min_positions(v[i:i + most], w) + i
                                         for i in range(0, n - w + 1, step)]))
    key = ((v >> shift) << shift) | np.arange(n, dtype=np.uint64)
    if w == 1:
        return np.arange(n)
    pad = -n % w
    a = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    pre = np.minimum.accumulate(a, axis=1).ravel()
    suf = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    low = np.minimum(suf[:m], pre[w - 1:w - 1 + m])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (low & ((U(1) << shift) - U(1))).astype(np.int64)


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def row_key(doc_id, data: bytes) -> bytes:
    """128-bit key of a (doc_id, text) row: rows that repeat both are the same row."""
    d = "" if doc_id is None or doc_id != doc_id else str(int(doc_id))
    return hashlib.blake2b(data, digest_size=16, key=d.encode()[:64]).digest()


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark longs."""
    return np.ascontiguousarray(h).view(np.int64)


def slices(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose summed size stays near ``limit``."""
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def batch_words(texts: list[bytes], sep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: word hashes and their byte starts and ends within the text."""
    out: list = []
    for lo, hi in slices([len(t) for t in texts]):
        part = texts[lo:hi]
        h, s, e = word_hashes(b" ".join(part), sep)
        lens = np.array([len(t) + 1 for t in part], np.int64)
        begin = np.concatenate([[0], np.cumsum(lens)])
        cut = np.searchsorted(s, begin)
        for i in range(len(part)):
            a, b = cut[i], cut[i + 1]
            out.append((h[a:b], s[a:b] - begin[i], e[a:b] - begin[i]))
    return out
