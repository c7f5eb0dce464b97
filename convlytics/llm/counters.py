"""Corpus-wide counters of a fixed size, added up by tasks and then by slice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convlytics.llm import textkit as T

SCHEMA = "slice int, counts binary"
SLICE = 1 << 14


def slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counters as rows of ``SLICE`` counters; empty slices are left out."""
    yield _batch(enumerate(np.array_split(total, max(1, -(-len(total) // SLICE)))))


def _batch(rows: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    full = [(i, r.astype(np.int64).tobytes()) for i, r in rows if r.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in full], pa.int32()),
                                       pa.array([r for _, r in full], pa.binary())], ["slice", "counts"])


def total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks' slices: ``size`` counters on the driver.

    Tasks add slices while they stream by, so memory does not grow with the
    number of tasks before; the driver gets one row per slice.
    """

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(r, np.int64)
                held[i] = held[i] + r if i in held else r
        yield _batch(held.items())

    n = max(1, -(-size // SLICE))
    out = np.array_split(np.zeros(size, np.int64), n)
    for row in parts.repartition(n, "slice").mapInArrow(add, SCHEMA).collect():
        out[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return np.concatenate(out)


def _slots(ids: pa.Array, bits: int) -> np.ndarray:
    """A bit number for each long; null is a value of its own."""
    values = np.asarray(ids.fill_null(-(2**63) + 7)).astype(np.int64).view(np.uint64)
    return (T.mix(values + np.uint64(0x632BE59BD9B4E019)) & np.uint64(bits - 1)).astype(np.int64)


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Packed bitmap of ``bits`` hashed places with those of a long column set.

    Tasks set their own bits, and slices of the bitmaps are joined by OR while
    they stream by: the driver gets ``bits / 8`` bytes whatever the input.
    """
    width = 1 << 16

    def batch(held):
        full = [(i, r.tobytes()) for i, r in held if r.any()]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in full], pa.int32()),
                                           pa.array([r for _, r in full], pa.binary())], ["slice", "counts"])

    def own(batches):
        packed = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _slots(b.column(0), bits)
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield batch(enumerate(np.array_split(packed, max(1, len(packed) // width))))

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(r, np.uint8)
                held[i] = held[i] | r if i in held else r
        yield batch(held.items())

    n = max(1, bits // 8 // width)
    out = np.array_split(np.zeros(bits // 8, np.uint8), n)
    for row in ids.mapInArrow(own, SCHEMA).repartition(n, "slice").mapInArrow(join, SCHEMA).collect():
        out[row["slice"]] |= np.frombuffer(row["counts"], np.uint8)
    return np.concatenate(out)


def marked(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which ids may be in the bitmap (none that is in it is missed)."""
    at = _slots(ids, 8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
