"""Row filters of the message and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixed import EARLIEST_DATE, FAILED
from tallymark.functions.labels import any_equals
from tallymark.functions.numbers import is_zero_vector


def dated(df: DataFrame, column: str = "date", after: str = EARLIEST_DATE) -> DataFrame:
    """Messages strictly after a day in UTC; sentinel and null dates go too.

    A plain comparison with a literal, so it reaches the parquet scan.
    """
    return df.filter(F.col(column) > F.lit(f"{after} 00:00:00+00:00").cast("timestamp"))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def not_failed(df: DataFrame, column: str = "category") -> DataFrame:
    return df.filter(F.col(column) != FAILED)


def nonzero_vectors(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_zero_vector(column))


def only_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    return df.filter(F.col("model").isin(list(models)))


def any_vote(wide: DataFrame, models: Sequence[str], category: str) -> DataFrame:
    """Wide rows in which at least one model chose ``category``."""
    return wide.filter(any_equals([f"`{m}`" for m in models], category))


def winners(results: DataFrame, rank: str = "rank_test_score") -> DataFrame:
    return results.filter(F.col(rank) == 1)


def fill(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(columns) if columns else None)


def timestamp_utc(column: str | Column) -> Column:
    """Microsecond timestamp; the session runs in UTC."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp")
