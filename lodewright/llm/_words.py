"""Words and word hashes of Arrow string columns, vectorised over UTF-8 bytes.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; UTF-8 keeps multi-byte characters clear of both.
Work goes in pieces of about ``PIECE`` bytes, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.full(max(n, PIECE + 4096), _P if which == "p" else _PINV, np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= 4 * PIECE:
            _powers[which] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole rows, about ``limit`` bytes each."""
    raw, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def split(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sp = space[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, sp[:-1]
    before[off[:-1][off[:-1] < n]] = True
    after[-1], after[:-1] = True, sp[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(~sp & before)
    return starts, np.flatnonzero(~sp & after) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ascending, disjoint span of ``raw``: a polynomial over random byte values, then mixed."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        part = _TABLE[raw[lo:hi]] * _power("p", hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s = starts[a:b] - lo
        out[a:b] = (total[ends[a:b] - lo] - total[s]) * _power("i", hi - lo)[np.minimum(s, hi - lo - 1)]
        a = b
    return mix(out)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] |= 32
    return out


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row's span ``off[i]:off[i + 1]``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def row_of(off: np.ndarray) -> np.ndarray:
    """For each element of the spans, its row."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
