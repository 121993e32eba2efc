"""Words of whole Arrow string columns as arrays: found and hashed without a Python object per word.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]`` in the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 21
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RADIX = 0x9FB21C651E98DF25
_INVERSE = pow(_RADIX, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POW or len(_POW[base]) < n:
        p = np.full(max(n, 4096), base, np.uint64)
        p[0] = 1
        _POW[base] = np.cumprod(p)
    return _POW[base]


def byte_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string column; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n, start = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64, n + 1, start * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes with their offsets and bytes; a longer text stands alone."""
    off, data = byte_column(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def find_words(off: np.ndarray, data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the rows.

    ``breaks``: row starts other than ``off``, for rows cut into finer sequences.
    """
    solid = ~SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = ~solid[:-1]
        edge[off] = True
        first = solid & edge[:-1]
        edge[1:-1] = ~solid[1:]
        edge[off] = True
        last = solid & edge[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off if breaks is None else breaks)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; spans ascend by start. Works block by block."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STEP)))
        low, high = int(starts[i]), int(ends[i:j].max())
        up, down = _powers(_RADIX, high - low + 1), _powers(_INVERSE, high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[:high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, and the word offsets of the rows."""
    low = LOWER[data]
    starts, ends, rows = find_words(off, low)
    return hash_spans(low, starts, ends), rows


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of several hash columns."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of hashes; runs may overlap. Works block by block."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STEP)))
        low, high = int(starts[i]), int(ends[i:j].max())
        up, down = _powers(_RADIX, high - low + 1), _powers(_INVERSE, high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(mix(values[low:high]) * up[:high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def find_runs(off: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of solid bytes inside a row, and the run offsets of the rows."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before[:len(solid)] | edge[:-1]))
    ends = np.flatnonzero(solid & (~after[:len(solid)] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)
