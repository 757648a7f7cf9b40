"""k-centre sampling: rows of a class that lie far from each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.keys import order_hash
from tallymark.operators.statistics import values_at
from tallymark.session import cut_lineage

#: Share of the sorted distances at which the next row is taken.
POSITION = 0.95
#: Largest class that one task works on; larger ones are picked by the cluster.
TASK_BYTES = 128 * 1024 * 1024
#: Picks between two checkpoints of the running distances.
STRIDE = 16


def _unit(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _cosine(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    # einsum adds each row up in the same order whatever the number of rows,
    # so both ways below see the same distances.
    return np.round(1.0 - np.einsum("ij,j->i", rows, to), 12)


def _pick_in_task(rows: pd.DataFrame, key: str, vector: str, n: int) -> list:
    """Keys picked from one class held in memory."""
    rows = rows.sort_values(key, ignore_index=True)
    units = _unit(rows[vector])
    chosen = [int(rows["start"].to_numpy().argmin())]
    free = np.ones(len(rows), dtype=bool)
    free[chosen] = False
    gap = _cosine(units, units[chosen[0]])
    at = int(len(rows) * POSITION)
    for _ in range(n - 1):
        bound = np.partition(gap, at)[at]
        above = np.flatnonzero(free & (gap >= bound))
        if len(above):
            pick = above[np.argmin(gap[above])]
        else:
            rest = np.flatnonzero(free)
            pick = rest[np.flatnonzero(gap[rest] == gap[rest].max())[-1]]
        chosen.append(int(pick))
        free[pick] = False
        gap = np.minimum(gap, _cosine(units, units[pick]))
    return rows[key].iloc[chosen].tolist()


def kcentre_sample(
    df: DataFrame,
    *,
    group: str,
    key: str,
    vector: str,
    n: int,
    seed: int = 0,
    task_bytes: int = TASK_BYTES,
    stride: int = STRIDE,
) -> DataFrame:
    """``n`` diverse rows of every class; classes of at most ``n`` rows come whole.

    Starting from a seeded row, each step takes the row at the 95 % position of
    the distances to the rows already chosen (the next free one above it, or
    the farthest free one if there is none). Ties go by key.

    Classes are counted first. Those that fit a task are handled by one grouped
    function. For larger ones every step is a Spark job over all of them: the
    exact position is found by counting, and only the picks, ``n`` per class,
    reach the driver. Both ways give the same rows.
    """
    # A class by its text, a null class too: that is one like any other.
    named = F.when(F.col(group).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    whole_frame, df = df, df.select(named.alias("__group"), key, vector)
    group = "__group"
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("width")
    )
    counts = {row[group]: (row["rows"], row["width"]) for row in sizes.collect()}
    whole = [g for g, (rows, _) in counts.items() if rows <= n]
    local = [g for g, (rows, w) in counts.items() if rows > n and rows * w * 24 <= task_bytes]
    large = [g for g, (rows, w) in counts.items() if rows > n and rows * w * 24 > task_bytes]
    slim = df.select(group, key, vector, order_hash(key, seed).alias("start"))

    parts = []
    if whole:
        parts.append(df.filter(F.col(group).isin(whole)).select(key))
    if local:
        schema = T.StructType([df.schema[key]])

        def pick(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({key: _pick_in_task(rows, key, vector, n)})

        parts.append(slim.filter(F.col(group).isin(local)).groupBy(group).applyInPandas(pick, schema))
    if large:
        keys = _pick_by_jobs(slim.filter(F.col(group).isin(large)), group, key, vector, n,
                             {g: counts[g][0] for g in large}, stride)
        parts.append(df.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([df.schema[key]])))
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    return whole_frame.join(chosen, key, "left_semi")


def _pick_by_jobs(slim: DataFrame, group, key, vector, n, sizes: dict, stride: int) -> list:
    start = slim.groupBy(group).agg(F.min_by(F.struct(key, vector), "start").alias("pick"))
    picks = {row[group]: [(row["pick"][key], row["pick"][vector])] for row in start.collect()}
    at = F.create_map(*[F.lit(x) for g, rows in sizes.items() for x in (g, int(rows * POSITION))])
    state = slim.drop("start").withColumn("gap", F.lit(float("inf")))
    since = 0
    for step in range(1, n):
        recent = {g: _unit([v for _, v in found[since:]]) for g, found in picks.items()}
        taken = [k for found in picks.values() for k, _ in found]

        @F.pandas_udf(T.DoubleType())
        def shrink(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for groups, vectors, gaps in batches:
                units, out = _unit(vectors), gaps.to_numpy(copy=True)
                names = groups.to_numpy()
                for name in pd.unique(groups):
                    mine = np.flatnonzero(names == name)
                    for to in recent[name]:
                        out[mine] = np.minimum(out[mine], _cosine(units[mine], to))
                yield pd.Series(out)

        now = state.withColumn("gap", shrink(group, vector, "gap"))
        if len(next(iter(picks.values()))) - since >= stride:
            now = state = cut_lineage(now)
            since = step
        ranked = values_at(now.withColumn("at", at[F.col(group)]), "gap",
                           {"bound": lambda _: F.col("at")}, group=[group, "at"])
        free = now.join(ranked.select(group, "bound"), group).filter(~F.col(key).isin(taken))
        row = F.struct(key, vector)
        nexts = free.groupBy(group).agg(
            F.min_by(row, F.when(F.col("gap") >= F.col("bound"), F.struct("gap", key))).alias("above"),
            F.max_by(row, F.struct("gap", key)).alias("farthest"),
        )
        for found in nexts.collect():
            best = found["above"] or found["farthest"]
            picks[found[group]].append((best[key], best[vector]))
    return [k for found in picks.values() for k, _ in found]
