"""Vectorised text helpers that run inside Spark tasks: words, hashes, blocks of an Arrow batch.

Texts are handled as the UTF-8 bytes Arrow already holds.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WHITE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(fold_case: bool = True, seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte; with ``fold_case`` A-Z share those of a-z."""
    table = mix((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed)) * _GOLD)
    if fold_case:
        table[65:91] = table[97:123]
    return table


def char_class(member: Callable[[int], bool]) -> np.ndarray:
    return np.array([member(b) for b in range(256)])


NOT_WHITE = char_class(lambda b: b not in WHITE)
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = char_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES * 2, 1 << int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _STEP), np.full(size, _STEP_INVERSE)
        up[0] = down[0] = 1
        pair = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > BLOCK_BYTES * 2:  # of a very long text: not kept
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column end to end, and where each begins and the last ends."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and end text, bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and the number of words before each text (and in all)."""
    inside = member[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    return summed_spans(byte_sums(data, table), starts, ends)


def byte_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What ``summed_spans`` needs of the bytes, once for all spans."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def summed_spans(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """``span_hashes`` from the bytes' sums."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values; order matters."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += words[k : k + n]
    return mix(out)


def row_batches(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn, ddl: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by a function from one batch to batches."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, ddl)


def passed_batch(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch under the names and types of ``schema``."""
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


def spare_name(taken, name: str) -> str:
    """``name``, or with underscores until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name
