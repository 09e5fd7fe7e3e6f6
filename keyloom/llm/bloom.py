"""Bloom filters built in tasks and merged by Spark: keys seen once, keys seen twice or more.

A filter has a fixed number of bits, whatever the data: what is merged, collected and
broadcast never grows with the rows.  More keys than it was sized for only raise the share of
false positives, which every user of a filter must settle exactly anyway.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.llm.textops import mix

CHUNK = 1 << 13  # bytes of a filter in one row while merging


class TwiceFilter:
    """Two bit sets over the same hash positions: ``once`` and ``twice``."""

    def __init__(self, bits: int, probes: int = 4):
        if bits < 8 * CHUNK or bits & (bits - 1):
            raise ValueError("bits must be a power of two, 65536 at least")
        self.bits, self.probes = bits, probes
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def _positions(self, hashes: np.ndarray) -> np.ndarray:
        step = mix(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        at = hashes[:, None] + step[:, None] * np.arange(self.probes, dtype=np.uint64)
        return at & np.uint64(self.bits - 1)

    @staticmethod
    def _set(words: np.ndarray, at: np.ndarray) -> None:
        at = at.ravel()
        np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    @staticmethod
    def _all(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        """Add keys, each as often as it was seen."""
        if not len(hashes):
            return
        keys, counts = np.unique(hashes, return_counts=True)
        at = self._positions(keys)
        self._set(self.twice, at[(counts > 1) | self._all(self.once, at)])
        self._set(self.once, at)

    def chunks(self) -> pa.RecordBatch:
        """The chunks that hold anything."""
        once, twice = self.once.reshape(-1, CHUNK), self.twice.reshape(-1, CHUNK)
        full = np.flatnonzero(once.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([once[k].tobytes() for k in full], pa.binary()), pa.array([twice[k].tobytes() for k in full], pa.binary())],
            names=["chunk", "once", "twice"],
        )


CHUNK_DDL = "chunk int, once binary, twice binary"


def merged_chunks(parts: DataFrame) -> DataFrame:
    """One row per chunk: a key set in two parts' ``once`` counts as seen twice.

    Chunks arrive sorted and are folded one after the other, so a task holds one at a time,
    however many parts there are.
    """

    def run(batches):
        at, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["chunk", "once", "twice"])

        for batch in batches:
            for k, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, b = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
                if k != at:
                    if at is not None:
                        yield done()
                    at, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None:
            yield done()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, CHUNK_DDL)


def twice_bits(parts: DataFrame, bits: int) -> bytes:
    """The merged ``twice`` filter: ``bits / 8`` bytes on the driver, at any size of data."""
    out = bytearray(bits // 8)
    for row in merged_chunks(parts).select("chunk", "twice").toLocalIterator():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = bytes(row["twice"])
    return bytes(out)


def may_contain(filter_bytes: bytes, bits: int, hashes: np.ndarray, probes: int = 4) -> np.ndarray:
    probe = TwiceFilter.__new__(TwiceFilter)
    probe.bits, probe.probes = bits, probes
    return TwiceFilter._all(np.frombuffer(filter_bytes, np.uint8), probe._positions(hashes))
