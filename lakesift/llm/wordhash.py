"""64-bit hashes of words and word shingles, straight from an Arrow text column's buffer.

Words are maximal runs of bytes other than white space (space, tab, LF, VT, FF, CR); A-Z count as a-z. Hashes
are polynomials over the bytes, so one running sum gives every word's hash at once, then mixed to spread bits.
Equal words have equal hashes; different words collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
CHUNK_BYTES = 2 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
            for b in (_BASE, _INVERSE)
        ]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in offsets: bytes, word starts, word ends (in those bytes), and words per row."""
    base, top = int(offsets[0]), int(offsets[-1])
    own = raw[base:top]
    rows = offsets - base
    space = _SPACE[own]
    edge = np.zeros(len(own) + 1, bool)
    edge[rows] = True  # row limits part words too
    word = ~space
    starts = np.flatnonzero(word & (np.concatenate([[True], space[:-1]]) | edge[:-1])) if len(own) else np.zeros(0, int)
    ends = np.flatnonzero(word & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1 if len(own) else np.zeros(0, int)
    counts = np.diff(np.searchsorted(starts, rows))
    return own, starts, ends, counts


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per row) for the rows in offsets."""
    own, starts, ends, counts = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    power, inverse = _power_tables(len(own) + 1)
    run = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(_BYTE[own] * power[: len(own)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row. Rows with fewer words have their whole sequence as one."""
    for at, to in row_chunks(offsets):
        words, counts = word_hashes(raw, offsets[at : to + 1])
        windows = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            windows += words[k : k + len(windows)] * _SHINGLE[k]
        windows = mix(windows)
        first = 0
        for n in counts.tolist():
            if n >= width:
                own = np.sort(windows[first : first + n - width + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                yield mix((words[first : first + n] * _SHINGLE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            first += n
