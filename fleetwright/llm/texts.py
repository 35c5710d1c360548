"""Vectorised access to whole texts inside tasks: Arrow columns as bytes, words and hashes.

A null text counts as empty everywhere. Words are runs of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.random.default_rng(7).integers(1, 1 << 64, 2, dtype=np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64


class Slice(NamedTuple):
    """Rows ``first`` to ``last`` (exclusive) of a batch; row i has bytes ``bounds[i]:bounds[i + 1]``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Byte spans of the words of a slice; row i has words ``rows[i]:rows[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into runs of rows of about ``max_bytes``; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def row_starts(bounds: np.ndarray) -> np.ndarray:
    """First byte of every row that is not empty."""
    return bounds[:-1][bounds[:-1] < bounds[1:]]


def words_of(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words between the bytes that ``space`` marks."""
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = row_starts(bounds)
    begin[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1
    end[lasts] = inside[lasts]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that low bits are as good as high ones."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes wherever they stand.

    A span is taken eight bytes at a time, the last ones filled up with zeros; each eight go into the
    state by a bijection that is scrambled before the next, so spans that differ meet by chance only.
    """
    lengths = ends - starts
    state = mixed(lengths.astype(np.uint64) ^ _KEYS[0])
    if not len(data):
        return state
    # Eight bytes from each place on, as one number.
    eight = np.ndarray(len(data), "<u8", np.append(data, np.zeros(7, np.uint8)), strides=(1,))
    active, at = np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN)), 0
    while len(active):
        left = lengths[active] - at
        chunk = eight[starts[active] + at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        state[active] = mixed((state[active] ^ chunk) * _BASE + _KEYS[1])
        active, at = active[left > 8], at + 8
    seed = int(_KEYS[0])
    for k in np.flatnonzero(lengths > LONG_SPAN).tolist():
        state[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return state


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` adjacent words within a row, with the index of each one's first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = mixed(total * _BASE + hashes[k : k + count])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return total[at], at


def gather(values: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[at[i]:at[i] + lengths[i]]`` over i."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1])]
