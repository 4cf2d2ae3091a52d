"""Words of a batch of texts as numpy arrays, without Python strings.

A batch is the UTF-8 bytes of its texts end to end plus one offset per text.
Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which
never cuts a UTF-8 character. A word's hash is a polynomial over a random
64-bit value per byte, modulo 2^64, taken from running sums and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
#: Bytes of words hashed at a time.
_SPAN = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, ``n`` at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, _SPAN + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        have = _tables[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each text's first word (``n + 1`` entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range (ranges in ascending order)."""
    out = np.empty(len(starts), _U)
    value = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        s = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, s + _SPAN, side="right")))
        e = int(ends[j - 1])
        power, inverse = _powers(_BASE, e - s + 1)
        total = np.zeros(e - s + 1, _U)
        np.cumsum(value[data[s:e]] * power[:e - s], dtype=_U, out=total[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` word hashes from each position on (``len(h) - n + 1`` entries)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    if n <= 8:
        out = h[:m].copy()
        for j in range(1, n):
            out *= _U(_STEP)
            out += h[j:j + m]
        return mix(out)
    out = np.empty(m, _U)
    for s in range(0, m, _SPAN):
        k = min(_SPAN, m - s)
        power, inverse = _powers(_STEP, k + n)
        total = np.zeros(k + n, _U)
        np.cumsum(h[s:s + k + n - 1] * power[:k + n - 1], dtype=_U, out=total[1:])
        at = np.arange(k)
        out[s:s + k] = (total[at + n] - total[at]) * inverse[at]
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over ``grams`` positions: the ``n`` words lie in one text."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= end
