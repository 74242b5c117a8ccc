"""Arrow string columns as flat numpy arrays, without Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of n + 1 row borders); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, borders, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(borders, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into pieces of about `limit` bytes of its column `text`; a longer row is a piece by itself."""
    sizes = np.diff(flat(batch.column(text))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bytes of a word at most; a longer run is cut into words of this length.
LONGEST = 256


def word_starts(inside: np.ndarray, borders: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """True at the first byte of each word, given the bytes that are in words; words end at row borders."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opening = borders[:-1][borders[:-1] < len(inside)]
    first[opening] = inside[opening]
    at = np.flatnonzero(first)
    size = np.diff(np.r_[np.cumsum(inside, dtype=np.int64)[at] - 1, np.count_nonzero(inside)]) if len(at) else at
    for start, n in zip(at[size > longest].tolist(), size[size > longest].tolist(), strict=True):
        first[start : start + n : longest] = True
    return first


def slices(data: np.ndarray, table: np.ndarray, limit: int, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of one text of about `limit` bytes that cut no word; table: the bytes that words have."""
    start, n = 0, len(data)
    while n - start > limit:
        end = start + limit
        back = np.flatnonzero(~table[data[end - longest : end]])
        if len(back):
            end += int(back[-1]) + 1 - longest
        else:  # within a run that is cut from its start
            run = end - longest
            while run > start and table[data[run - 1]]:
                far = max(start, run - (1 << 16))
                gap = np.flatnonzero(~table[data[far:run]])
                run = far + int(gap[-1]) + 1 if len(gap) else far
            end -= (end - run) % longest
        yield start, end
        start = end
    yield start, n
