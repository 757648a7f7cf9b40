"""Repeatable samples, folds and the choice of messages worth labelling.

Seeded order is ``md5(key:seed)``. It depends on nothing but the key, so a
sample is the same for any partitioning, run or engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.fixed import (
    AGREE_PER_CLASS,
    ANY_VOTE_PER_CLASS,
    BOTTOM_BAND,
    FAILED,
    MIDDLE_HALF_BAND,
    TOP_BAND,
)
from tallymark.functions.keys import hash_prefix, order_hash
from tallymark.operators.positions import top_n, with_position, with_random_position
from tallymark.operators.votes import complete_rows, is_unanimous, long_votes, row_entropy


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(order_hash(key, seed), F.col(key))


def _near_the_front(slim: DataFrame, stratum: str, n: int) -> DataFrame:
    """Rows whose order hash may be among the first ``n`` of their stratum.

    Counts per (stratum, hash prefix) tell from which prefix on a row is too
    late. The bounds, one per stratum, are joined back: Spark broadcasts them
    while they are few. Rows without a stratum have no bound.
    """
    # Two digits: few enough buckets that every task combines its counts well.
    prefixed = slim.withColumn("__prefix", hash_prefix(F.col("__hash"), 2))
    sizes = prefixed.groupBy(stratum, "__prefix").agg(F.count(F.lit(1)).alias("__size"))
    earlier = (
        Window.partitionBy(stratum).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    last = (
        needed.filter((F.col("__before") < n) & F.col(stratum).isNotNull())
        .groupBy(stratum)
        .agg(F.max("__prefix").alias("__last"))
    )
    early = F.col("__last").isNull() | (F.col("__prefix") <= F.col("__last"))
    return prefixed.join(last, stratum, "left").filter(early).select(*slim.columns)


def stratified_sample(
    df: DataFrame, stratum: str, n: int, key: str, seed: int, *, rank: str | None = None
) -> DataFrame:
    """``min(n, size)`` rows of each stratum. ``key`` identifies a row.

    Most rows are ruled out by counting, before anything is sorted or moved.
    Ranking moves keys only; wide columns are fetched by a semi join for the
    few rows chosen.
    """
    slim = df.select(stratum, key).withColumn("__hash", order_hash(key, seed))
    front = _near_the_front(slim, stratum, n)
    chosen = top_n(front, [stratum], [F.col("__hash"), F.col(key)], n, rank=rank).drop("__hash")
    if set(df.columns) <= {stratum, key}:
        return chosen
    if rank is None:
        return df.join(chosen.select(key), key, "left_semi")
    return df.join(chosen.select(key, rank), key)


def folds(df: DataFrame, stratum: str, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Assign each row one of ``k`` folds, evenly within every stratum."""
    placed = with_random_position(df, key, seed, group=[stratum], name="__position")
    fold = F.pmod(F.col("__position"), F.lit(k)).cast("int")
    return placed.withColumn(name, fold).drop("__position")


def any_vote_sample(votes: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Up to ``n`` messages of each class that any model chose; classes may overlap.

    (message, class) pairs are made distinct first, so no scan per class.
    """
    pairs = votes.filter(F.col("category").isNotNull()).select(key, "category").distinct()
    return stratified_sample(pairs, "category", n, key, seed)


def entropy_bands(
    wide: DataFrame,
    models: Sequence[str],
    key: str,
    seed: int,
    *,
    top: int = TOP_BAND,
    half_middle: int = MIDDLE_HALF_BAND,
    bottom: int = BOTTOM_BAND,
) -> DataFrame:
    """Most, least and middling contested messages among the non-unanimous ones.

    Bands overlap when there are few rows, as slices of one sorted list do; a
    message then has one row per band. Entropy takes few values, so ties are
    ordered by the seeded hash. Counts over (entropy, hash prefix) buckets tell
    which few buckets the bands lie in; only their rows are sorted.
    """
    contested = wide.filter(~is_unanimous(models)).select(
        key,
        F.round(row_entropy(models), 9).alias("entropy"),
        order_hash(key, seed).alias("__hash"),
    )
    fall = F.round(-F.col("entropy") * F.lit(1e9)).cast("bigint")

    def middle(size: Column) -> tuple[Column, Column]:
        centre = F.floor(size / F.lit(2))
        return F.greatest(centre - F.lit(half_middle), F.lit(0)), centre + F.lit(half_middle)

    def in_a_band(first: Column, end: Column, size: Column) -> Column:
        low, high = middle(size)
        return (first < top) | (end > size - F.lit(bottom)) | ((first < high) & (end > low))

    placed = with_position(
        contested,
        order=[F.desc("entropy"), F.col("__hash"), F.col(key)],
        levels=[fall, hash_prefix(F.col("__hash"))],
        name="__position",
        total="__size",
        wanted=in_a_band,
    )
    at, size = F.col("__position"), F.col("__size")
    low, high = middle(size)
    bands = F.array_compact(
        F.array(
            F.when(at >= size - F.lit(bottom), F.lit("low")),
            F.when(at < F.lit(top), F.lit("high")),
            F.when((at >= low) & (at < high), F.lit("middle")),
        )
    )
    return placed.select(key, "entropy", F.explode(bands).alias("band"))


def labelling_set(
    votes: DataFrame,
    wide: DataFrame,
    models: Sequence[str],
    key: str,
    labelled: DataFrame,
    seed: int = 1,
    *,
    agree: int = AGREE_PER_CLASS,
    any_vote: int = ANY_VOTE_PER_CLASS,
) -> DataFrame:
    """Messages a person should label next, each with the first reason it was chosen.

    Complete, not yet labelled messages only. Reasons in order: models agree,
    low, high and middle entropy, then a vote for a class.
    """
    fresh = complete_rows(wide, models).join(labelled.select(key), key, "left_anti")
    agreed = fresh.filter(is_unanimous(models)).select(key, F.col(f"`{models[0]}`").alias("category"))
    agree_part = stratified_sample(agreed, "category", agree, key, seed).select(
        key, F.lit(0).alias("priority"), F.lit("agree").alias("reason")
    )
    rank = F.when(F.col("band") == "low", 1).when(F.col("band") == "high", 2).otherwise(3)
    band_part = entropy_bands(fresh, models, key, seed).select(
        key, rank.alias("priority"), F.col("band").alias("reason")
    )
    fresh_votes = long_votes(fresh, [key], models)
    vote_part = any_vote_sample(fresh_votes, any_vote, key, seed).select(
        key, F.lit(4).alias("priority"), F.lit("any vote").alias("reason")
    )
    return (
        agree_part.unionByName(band_part)
        .unionByName(vote_part)
        .groupBy(key)
        .agg(F.min(F.struct("priority", "reason")).alias("first"))
        .select(key, F.col("first.priority").alias("priority"), F.col("first.reason").alias("reason"))
    )


def labelling_queue(messages: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Messages with a seeded queue position and an empty label."""
    return with_random_position(messages, key, seed).withColumn(
        "supervised_label", F.lit(None).cast("string")
    )


def merge_labels(queue: DataFrame, new_labels: DataFrame, key: str) -> DataFrame:
    """Queue with newly given labels filled in; a null new label changes nothing."""
    fresh = new_labels.select(key, F.col("supervised_label").alias("__new"))
    return (
        queue.join(fresh, key, "left")
        .withColumn("supervised_label", F.coalesce("__new", "supervised_label"))
        .drop("__new")
    )


def resume_queue(queue: DataFrame) -> DataFrame:
    """The queue after its last labelled position."""
    last = queue.agg(
        F.coalesce(
            F.max(F.when(F.col("supervised_label").isNotNull(), F.col("position"))),
            F.lit(-1).cast("bigint"),
        ).alias("last")
    ).scalar()
    return queue.filter(F.col("position") > last)


def failed_or(column: str):
    """Votes with unseen messages counted as failures."""
    return F.coalesce(F.col(column), F.lit(FAILED))
