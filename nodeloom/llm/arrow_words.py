"""Distinct words of a batch of texts, split and counted by Arrow: what is slow is done once for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once, if they are of more than one row.
PART = 2 << 20


def slices(batches, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about PART bytes of their text column."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * PART / max(batch.column(column).nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls, none of which has a space in it."""
    if not len(values):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(pa.large_string()))
    return pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


def _distinct(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return strings(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def plain(texts: pa.Array) -> pa.Array:
    """The texts as one array of strings; a null is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def by_white_space(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the word at each place, the rows' offsets among the places), as str.split has them.

    White space at an end of a text makes an empty word there.
    """
    return _distinct(pc.utf8_split_whitespace(texts))


def by_spaces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same for what single spaces part; a line end is a word of its own."""
    return _distinct(pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " "))


def gathered(begin: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places begin[w] .. begin[w] + n[w] of all w in ``which``, one after the other, and where each w's are done."""
    count = n[which]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin[which] - ends + count, count), ends


def packed_values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a binary column's rows hold, end to end, and the rows' offsets in them; no row is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // size


def packed_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows hold the numbers between their offsets."""
    values = np.ascontiguousarray(values)
    at = np.ascontiguousarray(offsets, np.int64) * values.itemsize
    if not len(at) or at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])
