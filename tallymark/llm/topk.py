"""Exact top-k search by inner product with no-random-access aggregation.

Objects and queries meet in cells of bounded size. In a cell every dimension is a sorted
list of its objects. All lists are read in step, from both ends: an object met in a list has
its value there, one not met yet lies between the two values read last. From these come a
lower and an upper bound of its score for every query of the cell. When few objects have an
upper bound that reaches the k-th best lower bound, the rest cannot qualify: reading stops
and the scores of those few are resolved. At the end of the lists bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.tables import map_rows

#: Rows of a cell at most, nearly: objects and queries.
OBJECTS = 8192
QUERIES = 2048
#: Queries whose bounds are held at a time.
BATCH = 128
#: Parts of a list read from each end before bounds are looked at.
DEPTHS = (0.3, 0.4, 0.45)
#: Reading stops for a query once so many objects for each wanted one can still qualify.
SLACK = 8

_KINDS = {b"1": "<i1", b"2": "<i2", b"4": "<i4", b"8": "<i8"}


def pack_vector(row: np.ndarray) -> bytes:
    """A vector of whole numbers in the narrowest width that holds it."""
    low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
    for mark, kind in _KINDS.items():
        info = np.iinfo(kind)
        if info.min <= low and high <= info.max:
            return mark + row.astype(kind).tobytes()
    raise AssertionError("wider than 64 bits")


def unpack_vectors(packed: list[bytes]) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with 0."""
    rows = [np.frombuffer(p, _KINDS[p[:1]], offset=1) for p in packed]
    wide = max((len(r) for r in rows), default=0)
    found = np.zeros((len(rows), wide), np.int64)
    for i, row in enumerate(rows):
        found[i, : len(row)] = row
    return found


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``vec_id`` and packed ``floor(scale * x)`` of the vectors that are whole: no null, all finite. Repeated rows count once."""
    usable = df.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & F.forall(vector_column, lambda x: x.isNotNull()))

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, packed = [], []
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(row).all():
                ids.append(key)
                with np.errstate(over="ignore"):
                    packed.append(pack_vector(np.clip(np.floor(scale * row), -(2.0**62), 2.0**62).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "packed"])

    rows = map_rows(usable, [F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")], pack, "vec_id long, packed binary")
    return rows.groupBy("vec_id", "packed").agg(F.count("*").alias("copies")).drop("copies")


def best_of_cell(ids: np.ndarray, objects: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best objects of each query: query ids, object ids and scores; an object of the query's id is left out."""
    n, wide = objects.shape
    if not n or not len(queries):
        return (np.empty(0, np.int64),) * 3
    most = float(np.abs(objects).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(wide, 1)
    # Bounds in the narrowest arithmetic that is exact; beyond doubles in whole numbers.
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    low_end = np.finfo(kind).min if kind is not np.int64 else np.iinfo(kind).min
    lists = np.argsort(objects, axis=0, kind="stable")
    values = np.take_along_axis(objects, lists, axis=0)
    dimensions = np.arange(wide)
    by_id = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[by_id], query_ids, "left"), np.searchsorted(ids[by_id], query_ids, "right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # What is known of each object in each list: the values it lies between.
    at_least = np.broadcast_to(values[0], (n, wide)).astype(kind)
    at_most = np.broadcast_to(values[-1], (n, wide)).astype(kind)
    waiting = np.arange(len(queries))
    read = 0
    for depth in [*(int(n * d) for d in DEPTHS), -(-n // 2)]:
        if not len(waiting):
            break
        if depth <= read:
            continue
        for part in (lists[read:depth], lists[n - depth : n - read]):
            exact = objects[part, dimensions]
            at_least[part, dimensions] = exact
            at_most[part, dimensions] = exact
        read = depth
        unseen = lists[depth : n - depth]
        if len(unseen):
            at_least[unseen, dimensions] = values[depth - 1]
            at_most[unseen, dimensions] = values[n - depth]
        still = []
        for start in range(0, len(waiting), BATCH):
            batch = waiting[start : start + BATCH]
            plus, minus = np.maximum(queries[batch], 0).astype(kind), np.minimum(queries[batch], 0).astype(kind)
            lower = plus @ at_least.T + minus @ at_most.T
            upper = plus @ at_most.T + minus @ at_least.T
            for i, q in enumerate(batch):
                own = by_id[first[q] : last[q]]
                lower[i, own] = upper[i, own] = low_end
            wanted = min(k, n)
            bar = np.partition(lower, n - wanted, axis=1)[:, n - wanted]
            open_still = (upper >= bar[:, None]) & (upper > low_end)
            counts = open_still.sum(axis=1)
            for i, q in enumerate(batch):
                if counts[i] > SLACK * k and len(unseen):
                    still.append(q)
                    continue
                chosen = np.flatnonzero(open_still[i])
                scores = objects[chosen] @ queries[q]
                order = np.lexsort((ids[chosen], -scores))[:k]
                found.append((np.full(len(order), query_ids[q]), ids[chosen][order], scores[order]))
        waiting = np.array(still, np.int64)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def search(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best rows for each query.

    Queries are the rows whose id is divisible by ``every``; all rows of other ids are candidates. Scores are
    inner products of ``floor(scale * x)``, ties go to the smaller id. Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without an id; repeated rows count
    once, rows of one id with different vectors each. Shorter vectors are filled up with 0. A
    query gets all candidates if there are fewer than ``k``; further columns are left out.
    """
    rows = quantised(df, id_column, vector_column, scale)
    # Counted on ids alone, to size the grid of cells.
    total, asked = df.agg(F.count(id_column), F.count(F.when(F.col(id_column) % every == 0, 1))).first()
    across, down = max(1, -(-total // OBJECTS)), max(1, -(-asked // QUERIES))
    column = F.pmod(F.xxhash64("vec_id", "packed"), F.lit(across))
    line = F.pmod(F.xxhash64("packed", "vec_id"), F.lit(down))
    objects = rows.select("vec_id", "packed", column.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "packed", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), line.alias("y"))
    schema = "query_id long, vec_id long, score long"

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        objects, queries = unpack_vectors(left["packed"].tolist()), unpack_vectors(right["packed"].tolist())
        wide = max(objects.shape[1], queries.shape[1])
        objects, queries = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (objects, queries))
        found = best_of_cell(left["vec_id"].to_numpy(np.int64), objects, right["vec_id"].to_numpy(np.int64), queries, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    x = F.col("x").cast("long").alias("x")
    y = F.col("y").cast("long").alias("y")
    near = objects.select("vec_id", "packed", x, y).groupBy("x", "y").cogroup(queries.select("vec_id", "packed", x, y).groupBy("x", "y")).applyInPandas(cell, schema)
    # The rank filter works on each task's rows before they are shuffled.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
