"""Exact order statistics and token statistics that survive hot groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixed import TOKEN_QUANTILE
from tallymark.functions.keys import match_id
from tallymark.functions.numbers import as_count, value_bucket
from tallymark.operators.positions import rows_before
from tallymark.schemas import NATURAL_KEY

Position = Callable[[Column], Column]
#: Rows behind one counted value, for ``totals`` expressions.
ROWS = "__rows"


def nearest_rank(q: float) -> Position:
    """0-based position of the value nearest to ``q (n - 1)``."""
    return lambda n: F.round((n - F.lit(1)).cast("double") * F.lit(q)).cast("bigint")


def lower_middle(n: Column) -> Column:
    return F.floor((n - F.lit(1)) / F.lit(2)).cast("bigint")


def upper_middle(n: Column) -> Column:
    return F.floor(n / F.lit(2)).cast("bigint")


def values_at(
    df: DataFrame,
    value: str,
    positions: Mapping[str, Position],
    *,
    group: Sequence[str] = (),
    weight: str | None = None,
    flags: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact values at sorted positions of each group, one row per group.

    Equal values are counted before the shuffle, so repeated values cost
    nothing. Running counts are taken over value buckets and then inside a
    bucket; no task ever holds a group.

    ``totals`` are further sums over all rows of the group, written over the
    counted rows: the value, the ``flags`` columns and ``ROWS``. Flags are part
    of the counting key, so both uses of the counts share one scan and shuffle.
    """
    group, totals = list(group), dict(totals or {})
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        df.groupBy(*group, value, *flags)
        .agg(rows.cast("bigint").alias(ROWS))
        .withColumn("__bucket", value_bucket(F.col(value)))
        .withColumn("__count", F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.col(ROWS)))
    )
    ranked = rows_before(counted, group, ["__bucket", value], "__count")
    picks = []
    for name, position in positions.items():
        at = position(F.col("__all"))
        here = (at >= F.col("__before")) & (at < F.col("__before") + F.col("__count"))
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return ranked.groupBy(*group).agg(
        *picks, *[F.sum(column).alias(name) for name, column in totals.items()]
    )


def exact_median(df: DataFrame, value: str, group: Sequence[str], name: str, **more) -> DataFrame:
    """Median that averages the two middle values."""
    middle = values_at(
        df, value, {"__low": lower_middle, "__high": upper_middle}, group=group, **more
    )
    half = (F.col("__low") + F.col("__high")) / F.lit(2.0)
    return middle.withColumn(name, half).drop("__low", "__high")


def joined_token_counts(
    raw: DataFrame,
    cleaned: DataFrame,
    raw_tokens: str,
    clean_tokens: str,
    key: Sequence[str] = NATURAL_KEY,
) -> DataFrame:
    """The inner join of two message tables, as distinct token pairs with a row count.

    Copies of a message multiply in the join. Each side is counted per message
    first, and the product of the counts stands for the pairs: a message with a
    million copies gives one row, not a trillion.
    """
    left = (
        raw.select(match_id(key).alias("__id"), raw_tokens)
        .groupBy("__id", raw_tokens)
        .agg(F.count(F.lit(1)).alias("__left"))
    )
    right = (
        cleaned.select(match_id(key).alias("__id"), clean_tokens)
        .groupBy("__id", clean_tokens)
        .agg(F.count(F.lit(1)).alias("__right"))
    )
    return (
        left.join(right, "__id")
        .groupBy(raw_tokens, clean_tokens)
        .agg(F.sum(F.col("__left") * F.col("__right")).alias("pairs"))
    )


def token_statistics(
    counts: DataFrame, raw_tokens: str, clean_tokens: str, q: float = TOKEN_QUANTILE
) -> DataFrame:
    """Mean and high quantile of raw and cleaned token counts, truncated, in one row."""
    pairs = F.col("pairs")
    sides = F.array(
        F.struct(F.lit("clean").alias("text"), F.col(clean_tokens).alias("tokens"), pairs.alias("rows")),
        F.struct(F.lit("raw").alias("text"), F.col(raw_tokens).alias("tokens"), pairs.alias("rows")),
    )
    found = values_at(
        counts.select(F.inline(sides)),
        "tokens",
        {"high": nearest_rank(q)},
        group=["text"],
        weight="rows",
        totals={"all_rows": F.col(ROWS), "all_tokens": F.col("tokens") * F.col(ROWS)},
    ).withColumn("avg", F.try_divide(F.col("all_tokens").cast("double"), "all_rows"))

    def only(text: str, name: str) -> Column:
        return as_count(F.max(F.when(F.col("text") == text, F.col(name)))).alias(f"{name}_{text}")

    return found.agg(*[only(text, name) for name in ("avg", "high") for text in ("clean", "raw")])
