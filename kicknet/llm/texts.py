"""Texts as flat bytes: slices of Arrow batches and rolling hashes over them.

Hashes are polynomials modulo 2^64 over random byte values, taken from running
sums, so the hash of any span costs a few array operations. They are finished by a
mixing step. The tables come from a fixed rule: equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task; a longer text is handled alone.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def values(seed: int, n: int = 256) -> np.ndarray:
    """n random 64-bit numbers."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n at least."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 8) + 1, b, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64, out=p))
    if n <= 4 * CHUNK_BYTES:  # those for one very long text are not kept
        _powers[:] = made
    return made[0], made[1]


class SpanHash:
    """Hashes of spans [start, end) of one array of bytes or of 64-bit items."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        items = values(seed)[data] if data.dtype == np.uint8 else mix(data + values(seed, 1))
        ups, self._downs = powers(len(data))
        items = items * ups[: len(data)]
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(items, out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self._sums[end] - self._sums[start]) * self._downs[start] + length)

    def every(self, length: int) -> np.ndarray:
        """The hashes of all spans of a length, by start."""
        n = max(0, len(self._sums) - length)
        out = (self._sums[length:] - self._sums[:n]) * self._downs[:n]
        return mix(out + np.uint64(length))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about CHUNK_BYTES of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        data, offsets = string_parts(batch.column(at))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield (
                batch.slice(start, end - start),
                data[offsets[start] : offsets[end]],
                offsets[start : end + 1] - offsets[start],
            )
            start = end


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ and the row each lies in."""
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def int64(column: np.ndarray) -> pa.Array:
    """A long column from 64-bit numbers, bit for bit."""
    return pa.array(np.ascontiguousarray(column).view(np.int64))
