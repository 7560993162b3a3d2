"""Vectorised scans over the bytes of a whole Arrow batch of texts.

The functions see one flat ``uint8`` buffer that holds many texts back to back
and the ``starts``/``ends`` of each text in it.  Nothing here creates a Python
object per word, so a batch costs a fixed number of numpy passes.  Hashes are
polynomials modulo 2**64 over randomly mapped bytes and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
#: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes that begin a code point
LEAD = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: texts are taken in groups of about so many bytes; a longer text is a group of its own
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept between calls."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[e] - p[s]) * BASE_INVERSE**s`` the hash of ``data[s:e]``."""
    p = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=p[1:])
    return p


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    inverse = powers(BASE_INVERSE, len(p))
    return mix((p[e] - p[s]) * inverse[s] + (e - s).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``[^\\x20\\x09-\\x0D]+`` and how many words stand before each text (n+1 counts)."""
    gap = SPACE[data]
    begins = np.ones(len(data), bool)
    begins[1:] = gap[:-1]
    edge = offsets[:-1]
    begins[edge[edge < len(data)]] = True
    begins &= ~gap
    s = np.flatnonzero(begins)
    stop = np.ones(len(data), bool)
    stop[:-1] = gap[1:]
    last = offsets[1:] - 1
    stop[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = True
    stop &= ~gap
    e = np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, offsets)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring word hashes; ``len(h) - k + 1`` values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(k):
        out *= BASE
        out += h[i : i + n]
    return mix(out)
