"""Words of many texts at once: numpy arrays over the UTF-8 bytes of an Arrow column.

Bytes of characters beyond ASCII are all 0x80 or more, so word classes that name ASCII
characters only can be decided byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and where each text begins (one more at the end).

    Null counts as the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run goes over the end of a text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(flat: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """Starts and ends of all words, and the index of each text's first word."""
    starts, ends = runs(table[flat], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(size, _SPAN), base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold=LOWER) -> np.ndarray:
    """64-bit hashes of the byte ranges after ``fold``; equal texts have equal hashes.

    Works through about a megabyte at a time, so that its memory does not depend on the
    length of a text.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN)))
        low, high = starts[at], ends[to - 1]
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((fold[flat[low:high]].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct word shingles of each text as sorted hashes.

    A text with fewer than ``size`` words has its whole sequence as its one shingle, a text
    without words none.
    """
    joined = hashes.copy()
    for k in range(1, size):
        joined[: len(hashes) - k] = mix(joined[: len(hashes) - k] * np.uint64(_BASE)) + hashes[k:]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            short = hashes[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * np.uint64(_BASE)) + hashes[k : k + 1]
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out
