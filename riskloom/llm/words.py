"""Words of whole texts, in Arrow batches and as Spark expressions.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \x09-\x0D]+"


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts of a batch; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.StringArray, np.ndarray]:
    """All words of a batch in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # a leading or trailing space leaves an empty word
    counts = np.bincount(owner.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return words.filter(real), counts.astype(np.int64)


def string_buffers(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free string array laid end to end, and its offsets."""
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset: strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]: ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def word_array(text: Column) -> Column:
    """Words of a text as a Spark array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def pieces_of(batches, column: str, most: int = 16 << 20):
    """Record batches cut so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
