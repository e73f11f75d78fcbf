"""Numpy helpers that tasks use on Arrow text: bytes, words and rolling hashes.

Hashes are polynomials in an odd base modulo 2^64, so that the hash of any range follows from two
prefix sums; a finaliser spreads the bits. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1

# White space between words: blank and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more at the end).
    A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19
             ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with at most `most` bytes of text, or one row.

    Yields the rows, their bytes and offsets. Memory follows the longest single text.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        low, rows = 0, batch.num_rows
        while low < rows:
            high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
            high = min(max(high, low + 1), rows)
            yield (batch.slice(low, high - low), data[offsets[low]:offsets[high]],
                   offsets[low:high + 1] - offsets[low])
            low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept for the next call up to a million."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = (out[0], out[1])
        if size <= 1 << 20:
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which `ranges` takes the hash of any range."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(base, len(values))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values in [low, high) for arrays of bounds; equal values, equal hash."""
    return mix((sums[high] - sums[low]) * powers(base, len(sums))[1][low])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words before each text (one more at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    before, here, after = solid[:-2].copy(), solid[1:-1], solid[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranges(prefix(data, BYTE_BASE), starts, ends, BYTE_BASE)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(sizes: np.ndarray) -> np.ndarray:
    """For each element of consecutive groups of these sizes, its place within its group."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def window_ids(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window of `width` words that lies within one text."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    inside = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), inside)
    return first[text] + runs(inside), text
