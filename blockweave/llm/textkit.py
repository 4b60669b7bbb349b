"""Vectorised word and shingle hashing over Arrow string columns (numpy only, no Python object per word).

A batch of texts is one byte buffer with offsets. Words are the maximal runs of bytes other than
``0x20`` and ``0x09-0x0D``; A-Z are folded to a-z through the hash table itself. A word's hash is a
polynomial over its bytes (prefix sums, so each byte costs a few vector operations) followed by a
64-bit finaliser.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]
BASE = U(0x9E3779B97F4A7C15 | 5)
BASE_INV = U(pow(int(BASE), -1, 2**64))
COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Returns freed memory of this worker to the system; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
        p[0] = 1
        kept = np.cumprod(p, dtype=np.uint64)
        if n > 8 * CHUNK_BYTES:
            return kept
        _powers[name] = kept
    return _powers[name]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its len + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_large_binary(col.type) and not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (a, b) of about ``most`` bytes, each at least one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, first word of each row + total) of the words of a chunk of rows."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    space = SPACE[data]
    begins = ~space
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins[1:] &= space[:-1] | cut[1:n]
    starts = np.flatnonzero(begins)
    ends_mask = ~space
    ends_mask[:-1] &= space[1:] | cut[1:n]
    ends = np.flatnonzero(ends_mask) + 1
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(BYTE[data] * _power("up", BASE, n)[:n], out=run[1:])
    h = (run[ends] - run[starts]) * _power("down", BASE_INV, n)[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return h, starts, ends, np.searchsorted(starts, off, "left")


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the offsets by row; a row of fewer (but some) words has its whole sequence."""
    count = np.diff(first)
    n_sh = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(n_sh)))
    total = len(h)
    if total >= k:
        s = h[: total - k + 1] * COEF[0]
        for j in range(1, k):
            s = s + h[j : total - k + 1 + j] * COEF[j]
        s = mix(s)
    else:
        s = np.empty(0, np.uint64)
    out = np.empty(out_off[-1], np.uint64)
    long = count >= k
    if long.any():
        reps = n_sh[long]
        at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(out_off[:-1][long], reps) + at] = s[np.repeat(first[:-1][long], reps) + at]
    for r in np.flatnonzero((count > 0) & (count < k)):
        w = h[first[r] : first[r + 1]]
        out[out_off[r]] = mix((w * COEF[: len(w)]).sum(dtype=np.uint64, keepdims=True) + COEF[40:41] * U(len(w)))[0]
    return out, out_off


def distinct_by_row(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each row, with new offsets. Sorts ``s`` in place."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = s[1:] != s[:-1]
        starts = off[:-1][off[:-1] < len(s)]
        keep[starts] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return s[keep], total[off]


def shingle_sets(col: pa.Array, k: int):
    """For each chunk of rows: (row range, distinct shingle hashes, offsets by row)."""
    data, off = bytes_of(col)
    for a, b in chunks(off):
        part = data[off[a] : off[b]]
        h, _, _, first = words(part, off[a : b + 1] - off[a])
        yield a, b, *distinct_by_row(*shingles(h, first, k))
