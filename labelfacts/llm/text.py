"""Vectorised text primitives: byte pieces of Arrow string columns, token spans and rolling hashes.

All functions work on whole rows; a piece holds as many rows as fit in PIECE bytes, and one longer row makes a piece by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
_P, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_INV = U(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: Bytes that part words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that part bare words: all ASCII but letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 195, 128..158 is an upper-case Latin letter of UTF-8; its second byte is lowered after 195.


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U(30))
    h = h * _M1
    h ^= h >> U(27)
    h *= _M2
    h ^= h >> U(31)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by a plain sort, which is several times as fast as np.unique's hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE)
        base = np.full(size, _P if kind == "p" else _INV, U)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(base, dtype=U)
        if size <= 4 * PIECE:  # those of a longer text aren't kept
            _powers[kind] = have
    return have[:n]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of runs of whole rows. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: workers are used again by later stages, and glibc would keep what one stage took at its peak."""
    if _libc is not None:
        _libc.malloc_trim(0)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte: no position moves."""
    out = LOWER[data]
    if len(out) > 1:
        latin = np.flatnonzero((data[:-1] == 195) & (data[1:] >= 128) & (data[1:] <= 158) & (data[1:] != 151)) + 1
        out[latin] += 32
    return out


def spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of each maximal run of bytes outside ``apart``; runs end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~apart[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    first = np.flatnonzero(inside & (~before | cut[:-1]))
    last = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by one prefix sum over all bytes."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("p", len(data)), out=sums[1:])
    return mix((sums[last] - sums[first]) * _power("i", len(data) + 1)[first] + (last - first).astype(U))


def windows(values: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive values in one row, and the index of each one's first value."""
    n = len(values)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * _power("p", n), out=sums[1:])
    start = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
    return mix((sums[start + k] - sums[start]) * _power("i", n)[start]), start


def features(data: np.ndarray, at: np.ndarray, bits: int, gram: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets below 2**bits of bare lower-case words and of byte grams, and the row of each; not made unique."""
    low = lower(data)
    first, last, row = spans(low, at, PUNCT)
    shift = U(64 - bits)
    word = (hash_spans(low, first, last) >> shift).astype(np.int32)
    flat = np.where(PUNCT[low], np.uint8(32), low).astype(U)
    n = len(flat) - gram + 1
    if n < 1:
        return word, row
    code = np.zeros(n, U)
    for j in range(gram):
        code = (code << U(8)) | flat[j : j + n]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = rows[:n] == rows[gram - 1 :]
    grams = ((code * _P) >> shift).astype(np.int32)
    return np.concatenate([word, grams[whole]]), np.concatenate([row, rows[:n][whole]])


def sets(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of all rows, by row, and where each row's begin (one more at the end)."""
    bucket, row = features(data, at, bits)
    key = distinct((row.astype(np.int64) << bits) | bucket)
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(at), dtype=np.int64) << bits)


def feature_sets(column: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct buckets of each row, sorted."""
    out: list[np.ndarray] = []
    for _, data, at in pieces(column):
        bucket, cut = sets(data, at, bits)
        out += [bucket[cut[i] : cut[i + 1]] for i in range(len(at) - 1)]
    return out


def row_sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """out[i] = values[cut[i]:cut[i + 1]].sum(0), 0 for an empty run."""
    out = np.zeros((len(cut) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        out[some] = np.add.reduceat(values, cut[some], axis=0, dtype=np.float64)
    return out


def linear(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    """For each row the sum of weights (buckets x outputs) over its distinct buckets. Buckets without weight cost no more than their look-up."""
    live = weights.any(axis=1)
    out = np.zeros((len(column), weights.shape[1]))
    for start, data, at in pieces(column):
        bucket, row = features(data, at, bits)
        seen = live[bucket]
        key = distinct((row[seen].astype(np.int64) << bits) | bucket[seen])
        cut = np.searchsorted(key, np.arange(len(at), dtype=np.int64) << bits)
        out[start : start + len(at) - 1] = row_sums(weights[key & ((1 << bits) - 1)], cut)
    return out
