"""Scaling, ranking scores and vector expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixed import RANKING_WEIGHTS
from tallymark.functions.text import _text


def percent(column: str | Column) -> Column:
    return _text(column) * F.lit(100.0)


def rounded(column: str | Column, places: int = 2) -> Column:
    return F.round(_text(column), places)


def as_count(column: str | Column) -> Column:
    """Truncate a statistic to a whole number."""
    return _text(column).cast("bigint")


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` between two bounds; null when they coincide."""
    return F.try_divide(value - low, high - low)


def minmax_over(df: DataFrame, columns: Sequence[str], inverted: Sequence[str] = ()) -> DataFrame:
    """Scale columns to 0..1 over the whole frame, ``1 - x`` for the inverted ones.

    The bounds are one-row scalar subqueries: no cross join and no unpartitioned
    window, whatever the size of the frame.
    """
    bounds = df.agg(
        F.struct(
            *[F.min(name).alias(f"{name}_low") for name in columns],
            *[F.max(name).alias(f"{name}_high") for name in columns],
        )
    ).scalar()
    scaled = {}
    for name in columns:
        value = minmax(F.col(name), bounds[f"{name}_low"], bounds[f"{name}_high"])
        scaled[name] = F.lit(1.0) - value if name in inverted else value
    return df.withColumns(scaled)


def weighted_sum(weights: Mapping[str, float] = RANKING_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(weight)
    return total


def entropy_term(share: Column) -> Column:
    """``-p ln p`` in nats, 0 for an empty share."""
    return F.when(share > 0, -share * F.ln(share)).otherwise(F.lit(0.0))


def element_sum(vector: str | Column) -> Column:
    return F.aggregate(_text(vector), F.lit(0.0), lambda total, x: total + x.cast("double"))


def is_zero_vector(vector: str | Column) -> Column:
    """Vectors whose elements sum to 0 mark a failed embedding run."""
    return element_sum(vector) == 0


def value_bucket(value: Column) -> Column:
    """Non-decreasing whole number of a value: sign, power of two and ten bits after it.

    Buckets are 0.1 % wide for large and small values alike; there are about four million.
    """
    size = F.least(F.abs(value.cast("double")), F.lit(1.7e308))
    power = F.floor(F.log2(size))
    after = F.floor((size / F.pow(F.lit(2.0), power) - F.lit(1.0)) * F.lit(1024.0))
    bucket = (power + F.lit(1100)) * F.lit(1024) + F.least(F.greatest(after, F.lit(0)), F.lit(1023)) + F.lit(1)
    bucket = F.when(size == 0, F.lit(0)).otherwise(bucket)
    return F.when(value < 0, -bucket).otherwise(bucket).cast("bigint")
