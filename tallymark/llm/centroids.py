"""Clustering around centroids in whole numbers, by scalar lookup tables.

A component ``x`` becomes the integer ``floor(scale * x)``. These take few values, so for each
dimension, occurring value and centroid the squared difference is tabulated once a round and task; the
distances of a batch are then gathered from the tables and summed, with no product per vector. Every round is
one pass over the vectors: a task adds up its vectors by cluster, and only one sum for each cluster and
dimension reaches the driver, whatever the number of vectors or tasks. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.tables import bound_batches

#: Values of a dimension that are tabulated as one range; beyond it those that occur are listed.
RANGE = 1 << 12


def narrow(width: int) -> int:
    """Whole numbers below it have squared distances within 64 bits; larger ones are computed without a bound."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def whole_vectors(column: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their integers (objects, if some are large)."""
    held = np.flatnonzero((pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width))
    flat = column.take(pa.array(held)).flatten()
    whole = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    whole &= np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        floors = np.floor(scale * values[whole])
    if not np.isfinite(floors).all():
        raise OverflowError("a component times the scale is beyond a double")
    if np.abs(floors).max(initial=0) < narrow(width):
        return held[whole], floors.astype(np.int64)
    return held[whole], np.array([[int(x) for x in row] for row in floors], object).reshape(-1, width)


class Tables:
    """Squared differences for each dimension, value and centroid of a round; a task keeps them for all its batches."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.held: dict[int, tuple[int, np.ndarray]] = {}

    def _tabulate(self, d: int, values: np.ndarray, kind: type) -> np.ndarray:
        return (values.astype(kind)[:, None] - self.centroids[None, :, d].astype(kind)) ** 2

    def gather(self, d: int, column: np.ndarray, kind: type) -> np.ndarray:
        low, high = int(column.min()), int(column.max())
        if d in self.held:
            first, table = self.held[d]
            low, high = min(low, first), max(high, first + len(table) - 1)
        if high - low >= RANGE:
            values, at = np.unique(column, return_inverse=True)
            return self._tabulate(d, values, kind)[at]
        if d not in self.held or len(self.held[d][1]) <= high - low:
            self.held[d] = low, self._tabulate(d, np.arange(low, high + 1), kind)
        first, table = self.held[d]
        return table[(column - first).astype(np.int64)]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to each centroid."""
        kind = object if object in (vectors.dtype, self.centroids.dtype) else np.int64
        total = np.zeros((len(vectors), len(self.centroids)), kind)
        for d in range(vectors.shape[1]):
            total += self.gather(d, vectors[:, d], kind)
        return total

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the first of equally near ones, and the squared distance."""
        far = self.distances(vectors)
        # Of objects and of integers alike, argmin takes the first of the least.
        nearest = far.argmin(axis=1)
        return nearest, far[np.arange(len(far)), nearest]


def _batches(batches: Iterator[pa.RecordBatch], width: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        at, vectors = whole_vectors(batch.column(batch.num_columns - 1), width, scale)
        if len(at):
            yield batch, at, vectors


def _totals(df: DataFrame, centroids: np.ndarray, scale: float) -> tuple[list[int], list[list[int]], list[int]]:
    """Rows, sums by dimension and summed distance of every cluster, exactly."""
    clusters, width = centroids.shape
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, inertia = [0] * clusters, [[0] * width for _ in range(clusters)], [0] * clusters
        tables = Tables(shared.value)
        for _, _, vectors in _batches(batches, width, scale):
            nearest, far = tables.assign(vectors)
            for c in np.unique(nearest).tolist():
                own = nearest == c
                rows[c] += int(own.sum())
                # A batch has far fewer than 2 ** 35 rows; whole batches are added without a bound.
                sums[c] = [held + int(x) for held, x in zip(sums[c], vectors[own].sum(axis=0))]
                inertia[c] += sum(map(int, far[own]))
        found = [(c, d, str(x)) for c in range(clusters) if rows[c] for d, x in enumerate([*sums[c], rows[c], inertia[c]])]
        names = ("cluster", "place", "held")
        kinds = (pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*found) if found else ((), (), ()), kinds)], list(names))

    found = df.mapInArrow(run, "cluster int, place int, held string").groupBy("cluster", "place").agg(F.sum(F.col("held").cast("decimal(38,0)")).alias("held"))
    table = [[0] * (width + 2) for _ in range(clusters)]
    # At most clusters * (width + 2) rows.
    for row in found.collect():
        table[row["cluster"]][row["place"]] = int(row["held"])
    return [t[width] for t in table], [t[:width] for t in table], [t[width + 1] for t in table]


def _as_array(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(x) < narrow(width) for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(-1, width)


def _starts(df: DataFrame, k: int, width: int, scale: float, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest digests of seed and id; rows without an id are none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, vectors in _batches(batches, width, scale):
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            order = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
            texts = [",".join(map(str, row)) for row in vectors.tolist()]
            rows = sorted(zip(order, vectors.tolist(), texts))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["digest", "vector"])

    found = df.filter(F.col("vec_id").isNotNull()).mapInArrow(run, "digest string, vector string")
    components = F.transform(F.split("vector", ","), lambda x: x.cast("decimal(38,0)"))
    rows = found.orderBy("digest", components).limit(k).collect()
    return _as_array([list(map(int, row["vector"].split(","))) for row in rows], width)


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector.

    Vectors of exactly ``width`` components, none null or not finite, take part; others are left out. Centroids start as
    the ``k`` vectors with the smallest sha256 of ``seed:id`` (of equal ids, the smaller components first; rows without
    an id are no starts, but are clustered). Each round gives every vector to the nearest centroid, the smaller number
    of equally near ones, and moves a centroid to the floor of its vectors' mean; one without vectors stays. Then
    vectors are given out once more. Repeated rows count each time. With fewer than ``k`` vectors there are as
    many centroids; without any there are no rows. A summed distance beyond 64 bits stops the job. Further columns are left out.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    schema = "vec_id long, cluster int, distance long"
    centroids = _starts(rows, k, width, scale, seed)
    if not len(centroids):
        nothing = spark.createDataFrame([], schema)
        return nothing.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    vectors = rows.select("vector")
    for _ in range(rounds):
        counts, sums, _ = _totals(vectors, centroids, scale)
        moved = [[x // n for x in s] if n else list(map(int, old)) for n, s, old in zip(counts, sums, centroids.tolist())]
        centroids = _as_array(moved, width)
    _, _, inertia = _totals(vectors, centroids, scale)
    if sum(inertia) >= 1 << 63:
        raise OverflowError("the summed distance is beyond 64 bits")
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch, at, held in _batches(batches, width, scale):
            nearest, far = tables.assign(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(nearest, pa.int32()), pa.array(far.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return rows.mapInArrow(run, schema).select(
        "vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256")
    )
