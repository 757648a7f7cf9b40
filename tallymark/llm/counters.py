"""Counters of fixed size that every task fills and Spark adds up."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters travel in parts of this many.
PART = 1 << 16
SCHEMA = "part int, counts binary"


def pack(counters: np.ndarray) -> pa.RecordBatch:
    """One zipped row for each part that isn't all zero."""
    pieces = []
    for i in range(0, len(counters), PART):
        held = counters[i : i + PART]
        if held.any():
            # In the narrowest width that holds them; its size follows from the row's length.
            kind = np.uint16 if held.max() < 1 << 16 else np.int64
            pieces.append((i // PART, len(held).to_bytes(4, "little") + zlib.compress(held.astype(kind).tobytes(), 1)))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], ["part", "counts"])


def unpack(blob: bytes) -> np.ndarray:
    held = zlib.decompress(blob[4:])
    wide = len(held) == 8 * int.from_bytes(blob[:4], "little")
    return np.frombuffer(held, np.int64 if wide else np.uint16).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # No more sums than there are parts, whatever the number of rows.
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = unpack(blob.as_py())
            totals[part] = totals[part] + held if part in totals else held
    for part, total in totals.items():
        row = pack(total)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(row), pa.int32()), row.column(1)], ["part", "counts"])


def add_up(packed: DataFrame, size: int) -> np.ndarray:
    """The sums over all tasks: ``size`` longs on the driver, part by part.

    Parts are first added in 16 groups each, so no task gathers what all tasks have sent.
    """
    salt = F.pmod(F.xxhash64("counts"), F.lit(16))
    once = packed.repartition("part", salt).mapInArrow(_sums, SCHEMA)
    total = np.zeros(size, np.int64)
    for row in once.repartition("part").mapInArrow(_sums, SCHEMA).toLocalIterator():
        held = unpack(row["counts"])
        total[row["part"] * PART : row["part"] * PART + len(held)] = held
    return total
