"""Words of whole texts as numpy arrays, a bounded slice of an Arrow batch at a time.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``. Everything works on UTF-8
bytes, so offsets are byte offsets into the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 1000  # rows per Arrow batch: whole texts of some kilobytes each
SLICE_BYTES = 1 << 19  # text bytes handled at once; one longer text is a slice of its own
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_TABLE_LENGTH = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def stream(start: int, n: int, seed: int = 0) -> np.ndarray:
    """``n`` pseudo-random 64-bit words: places start, start + 1, ... of the stream of ``seed``."""
    base = _U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(start + 1, start + n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + base)


_WEIGHTS = stream(0, _TABLE_LENGTH)


def _weights(n: int) -> np.ndarray:
    return _WEIGHTS[:n] if n <= _TABLE_LENGTH else stream(0, n)


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # n + 1 byte offsets of the texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """Find the words of the texts that lie end to end in ``data``; ``apart`` marks the bytes between words."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def hashes(words: Words, lower: bool = True) -> np.ndarray:
    """64-bit multilinear hash of every word, ASCII capitals folded when ``lower``."""
    if not len(words.start):
        return np.zeros(0, _U)
    length = words.end - words.start
    offset = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    place = np.arange(int(length.sum())) - np.repeat(offset, length)
    chars = words.data[place + np.repeat(words.start, length)]
    if lower:
        chars = LOWER[chars]
    weighed = (chars.astype(_U) + _U(1)) * _weights(int(length.max()))[place]
    return mix(np.add.reduceat(weighed, offset) + length.astype(_U))


def full_windows(hashed: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every window of ``width`` words within a text."""
    if len(hashed) < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    factor = stream(0, width, seed=7) | _U(1)
    n = len(hashed) - width + 1
    full = hashed[:n] * factor[0]
    for i in range(1, width):
        full = full + hashed[i : n + i] * factor[i]
    last = np.repeat(first[1:] - width, np.diff(first))[:n]  # where the last window of the word's text starts
    place = np.flatnonzero(np.arange(n) <= last)
    return mix(full[place] + _U(width)), place


def windows(hashed: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every ``width``-word window; a shorter text gives its whole sequence once."""
    factor = stream(0, width, seed=7) | _U(1)
    counts = np.diff(first)
    full, place = full_windows(hashed, first, width)
    texts = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array(
            [np.sum(hashed[first[i] : first[i + 1]] * factor[: counts[i]], dtype=_U) + _U(counts[i]) for i in short], dtype=_U
        )
        return np.concatenate([full, mix(whole)]), np.concatenate([texts[place], short])
    return full, texts[place]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches kept small enough for whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
