"""Vectorised text helpers over Arrow batches: words, lines and their 64-bit hashes.

Texts stay in Arrow's UTF-8 buffers; one numpy pass serves all documents of a
batch, so no per-word Python objects are made. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: bytes of one vectorised pass; larger texts are taken alone
PIECE = 1 << 21
#: bytes hashed at once; its tables of powers stay in every worker
STEP = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 2 * STEP:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string or binary column, and their offsets (n + 1)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.large_binary()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(wide)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        return buf[:0], np.zeros(1, np.int64)
    return buf[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word ``[^\\x20\\x09-\\x0D]+``; words end with their document."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range (ranges ascend and don't overlap), by prefix sums modulo 2^64."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        hi = int(ends[j - 1])
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[buf[lo:hi]] * _power_table(_BASE, hi - lo), out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * _power_table(_INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


_SHINGLE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with their document and first word.

    A document of fewer than k words, but one at least, gives its whole sequence as one shingle.
    """
    n = len(word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    m = max(0, n - k + 1)
    acc = np.zeros(m, np.uint64)
    for i in range(k):
        acc += word[i:i + m] * _SHINGLE[i]
    full = np.flatnonzero(doc[:m] == doc[k - 1:k - 1 + m]) if m else np.zeros(0, np.int64)
    h, d, at = mix(acc[full]), doc[full], full
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.searchsorted(doc, short)
        total = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            total[has] += word[begin[has] + i] * _SHINGLE[i]
        total += count[short].astype(np.uint64) * _SHINGLE[32]
        h, d, at = np.concatenate([h, mix(total)]), np.concatenate([d, short]), np.concatenate([at, begin])
        order = np.argsort(at, kind="stable")
        h, d, at = h[order], d[order], at[order]
    return h, d, at
