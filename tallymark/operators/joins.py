"""Equi-joins between message tables and with small dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.keys import match_id
from tallymark.functions.labels import drop_parenthesis
from tallymark.schemas import NATURAL_KEY


def join_messages(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    how: str = "inner",
    key: Sequence[str] = NATURAL_KEY,
) -> DataFrame:
    """Join two message tables on their key, taking ``columns`` from the right.

    A null in the key matches nothing. Copies of a message multiply in such a
    join. Equal right rows are folded before it, and ``copies`` says how many
    rows a plain join would give for each row here, so a message with a million
    copies on both sides stays a million rows. :func:`repeat_copies` writes
    them out. Only a digest of the key travels with the right side.
    """
    folded = (
        right.select(match_id(key).alias("__id"), *columns)
        .groupBy("__id", *columns)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = left.withColumn("__id", match_id(key)).join(folded, "__id", how).drop("__id")
    return joined.withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))


def without_messages(left: DataFrame, seen: DataFrame, key: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Rows of ``left`` whose message is not in ``seen``."""
    ids = seen.select(match_id(key).alias("__id"))
    return left.withColumn("__id", match_id(key)).join(ids, "__id", "left_anti").drop("__id")


def attach_vectors(
    predictions: DataFrame,
    vectors: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = NATURAL_KEY,
) -> DataFrame:
    """Predictions left-joined with embeddings; rows without a full set are dropped."""
    return join_messages(predictions, vectors, columns, "left", key).na.drop(subset=list(columns))


def repeat_copies(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Write each row as often as its ``copies`` column says."""
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return df.withColumn("__copy", each).drop("__copy", copies)


def attach_dimension(df: DataFrame, dimension: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of per-model values; adaptive execution broadcasts it by its real size."""
    return df.join(dimension, on, how)


def work_list(df: DataFrame, models: Sequence[str], resamples: int | None = None) -> DataFrame:
    """Every message for every model (and resample number), by generators, not joins."""
    out = df.withColumn("model", F.explode(F.array(*[F.lit(name) for name in models])))
    if resamples is not None:
        numbers = F.sequence(F.lit(0), F.lit(resamples - 1))
        out = out.withColumn("sample", F.explode(numbers))
    return out


def pending_work(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Work whose result does not exist yet."""
    return work.join(done.select(*on), list(on), "left_anti")


def completeness(done: DataFrame, expected: DataFrame, by: str = "model") -> DataFrame:
    """Rows done against rows expected, per model."""
    counted = done.groupBy(by).agg(F.count(F.lit(1)).alias("done"))
    wanted = expected.groupBy(by).agg(F.count(F.lit(1)).alias("expected"))
    return wanted.join(counted, by, "left").select(
        by,
        "expected",
        F.coalesce("done", F.lit(0).cast("bigint")).alias("done"),
        (F.coalesce("done", F.lit(0).cast("bigint")) == F.col("expected")).alias("complete"),
    )


def union_widened(*frames: DataFrame) -> DataFrame:
    """Union by column name in the first frame's order; numeric types widen."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*frames[0].columns))
    return out


def keep_first(df: DataFrame, key: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``priority``. Aggregated, so hot keys combine early."""
    others = [name for name in df.columns if name not in key]
    first = F.min_by(F.struct(*others), F.struct(*priority)).alias("__row")
    return df.groupBy(*key).agg(first).select(*key, "__row.*").select(*df.columns)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def labels_table(files: Mapping[str, DataFrame], label: str = "supervised_label") -> DataFrame:
    """Several files of labels as one table with the ``version`` each row comes from.

    Rows without a label go, class names lose their parenthesis. Columns are matched by
    name; a message labelled in several files has a row for each.
    """
    parts = [
        frame.filter(F.col(label).isNotNull()).withColumn(label, drop_parenthesis(label)).withColumn("version", F.lit(version))
        for version, frame in files.items()
    ]
    return union_widened(*parts)


def join_on_message(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the natural key as it stands: copies of a message multiply, nulls match nothing.

    The key columns come from ``left``.
    """
    mine = left.withColumn("__message", match_id())
    theirs = right.withColumn("__message", match_id()).drop(*NATURAL_KEY)
    return mine.join(theirs, "__message", how).drop("__message")
