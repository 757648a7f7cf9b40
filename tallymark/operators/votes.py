"""Votes of many models on the same messages.

``long`` frames have one row per (message, model); ``wide`` frames have one row
per message and one column per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.fixed import FAILED
from tallymark.functions.numbers import entropy_term


def wide_votes(
    df: DataFrame,
    key: Sequence[str],
    models: Sequence[str],
    *,
    category: str = "category",
    order: str,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """One column per model: its first vote by ``order``, null where it has none.

    The models are named, so no job is spent on finding them, and one aggregate
    replaces a join per model. Where the ``classes`` are known, numbers stand
    for them until after the shuffle. Numbers can be aggregated by hashing,
    while text has to be sorted first. A class outside the list is an error.
    """
    vote, names = F.col(category), None
    if classes is not None:
        names = F.array(*[F.lit(name) for name in classes])
        code = F.array_position(names, vote).cast("int")
        unknown = F.raise_error(F.concat(F.lit("unknown class "), vote)).cast("int")
        vote = F.when(code == 0, unknown).otherwise(code)
    slim = df.select(*key, "model", vote.alias("__vote"), F.col(order).alias("__order"))

    # One condition per model instead of pivot(), which would shuffle twice.
    def first(model: str) -> Column:
        mine = F.col("model") == model
        return F.min_by(F.when(mine, F.col("__vote")), F.when(mine, F.col("__order"))).alias(model)

    wide = slim.groupBy(*key).agg(*[first(model) for model in models])
    if names is None:
        return wide
    return wide.select(
        *key, *[F.get(names, F.col(f"`{m}`") - F.lit(1)).alias(m) for m in models]
    )


def join_votes(
    labels: DataFrame, votes: DataFrame, key: Sequence[str], models: Sequence[str], **how
) -> DataFrame:
    """Labelled messages with one vote column per model."""
    return labels.join(wide_votes(votes, key, models, **how), list(key), "left")


def long_votes(wide: DataFrame, key: Sequence[str], models: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(key), [F.col(f"`{m}`") for m in models], "model", "category")


def distinct_votes(models: Sequence[str]) -> Column:
    """Number of different votes in a row; a null is a vote of its own."""
    return F.size(F.array_distinct(F.array(*[F.col(f"`{m}`") for m in models])))


def is_unanimous(models: Sequence[str]) -> Column:
    return distinct_votes(models) == 1


def complete_rows(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Messages every model has seen."""
    return wide.na.drop(subset=[f"`{m}`" for m in models])


def unanimity_rate(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    agreed = F.avg(is_unanimous(models).cast("double")).alias("unanimity")
    return complete_rows(wide, models).agg(F.count(F.lit(1)).alias("messages"), agreed)


def unanimous_classes(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Class counts of unanimous messages with their sum (null rows included)."""
    counted = (
        wide.filter(is_unanimous(models))
        .groupBy(F.col(f"`{models[0]}`").alias("category"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return counted.withColumn("total", F.sum("messages").over(Window.partitionBy(F.lit(0))))


def class_counts(votes: DataFrame) -> DataFrame:
    """Votes per (model, class); failures and unseen messages are left out."""
    return (
        votes.filter(F.coalesce("category", F.lit(FAILED)) != FAILED)
        .groupBy("model", "category")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def class_totals(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy("category")
        .agg(F.sum("votes").alias("votes"))
        .orderBy(F.desc("votes"), "category")
    )


def counts_matrix(counts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Classes by models, 0 where a model never chose the class."""
    return counts.groupBy("category").pivot("model", list(models)).agg(F.sum("votes")).na.fill(0)


def class_shares(counts: DataFrame) -> DataFrame:
    """Share of each class in its model, and the class's summed share over models."""
    in_model, in_class = Window.partitionBy("model"), Window.partitionBy("category")
    share = F.try_divide(F.col("votes").cast("double"), F.sum("votes").over(in_model))
    return (
        counts.withColumn("share", share)
        .withColumn("class_share", F.sum("share").over(in_class))
        .orderBy(F.desc("class_share"), "category", "model")
    )


def pairwise_agreement(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Symmetric matrix, as rows, of how often two models agree; 1 on the diagonal.

    Each task codes its votes as numbers, compares all pairs of columns at once and
    hands on one small table of counts, so the plan doesn't grow with the number of
    models and no message is joined with itself. Rows in which either vote is null
    don't count for a pair.
    """
    models = list(models)
    width = len(models)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, both = np.zeros((width, width), np.int64), np.zeros((width, width), np.int64)
        for batch in batches:
            codes = pd.factorize(batch.to_numpy(object).ravel())[0].reshape(len(batch), width)
            known = codes >= 0
            both += known.T.astype(np.int64) @ known.astype(np.int64)
            for i in range(width):
                hits[i] += ((codes == codes[:, [i]]) & known[:, [i]]).sum(axis=0)
        i, j = np.triu_indices(width, 1)
        yield pd.DataFrame({"i": i, "j": j, "hits": hits[i, j], "both": both[i, j]})

    votes = wide.select(*[F.col(f"`{m}`").cast("string").alias(f"v{i}") for i, m in enumerate(models)])
    partial = votes.mapInPandas(count, "i long, j long, hits long, both long")
    rates = partial.groupBy("i", "j").agg(F.try_divide(F.sum("hits").cast("double"), F.sum("both").cast("double")).alias("rate"))
    cells = wide.sparkSession.range(width * width, numPartitions=1).select(
        F.floor(F.col("id") / width).alias("a"), (F.col("id") % width).alias("b")
    )
    cells = cells.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(rates, ["i", "j"], "left")
    names = F.array(*[F.lit(m) for m in models])
    agreement = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("rate"))
    return cells.select(
        F.get(names, F.col("a").cast("int")).alias("model_a"),
        F.get(names, F.col("b").cast("int")).alias("model_b"),
        agreement.alias("agreement"),
    ).withColumn("overlap_distance", F.lit(1.0) - F.col("agreement"))


def js_distance(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance between the class distributions of two models.

    Takes the (classes x models) count matrix, whose size does not depend on
    the number of messages, makes it long (class, model, share) and joins it
    with itself by class: a row per class and pair, whatever the number of models.
    """
    models = list(models)
    votes = F.array(*[F.col(f"`{m}`").cast("double") for m in models])
    whole = Window.partitionBy("model")
    long = (
        matrix.select("category", F.posexplode(votes).alias("model", "votes"))
        .withColumn("share", F.try_divide(F.col("votes"), F.sum("votes").over(whole)))
        .select("category", "model", "share")
    )
    other = long.select(F.col("category").alias("category_b"), F.col("model").alias("model_j"), F.col("share").alias("q"))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.ln(F.lit(2.0) * p / (p + q))).otherwise(F.lit(0.0))

    p, q = F.col("share"), F.col("q")
    sums = (
        long.join(other, F.col("category").eqNullSafe(F.col("category_b")) & (F.col("model") < F.col("model_j")))
        .groupBy("model", "model_j")
        .agg(F.sum(term(p, q) + term(q, p)).alias("total"))
    )
    names = F.array(*[F.lit(m) for m in models])
    return sums.select(
        F.get(names, "model").alias("model_a"),
        F.get(names, "model_j").alias("model_b"),
        F.sqrt(F.greatest(F.col("total") / F.lit(2.0), F.lit(0.0))).alias("distance"),
    )


def row_entropy(models: Sequence[str]) -> Column:
    """Entropy in nats of the votes of one wide row; one pass, no shuffle."""
    votes = F.array(*[F.col(f"`{m}`") for m in models])
    total = F.lit(float(len(models)))
    terms = F.transform(
        F.array_distinct(votes),
        lambda v: entropy_term(F.size(F.filter(votes, lambda x: x.eqNullSafe(v))) / total),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def vote_entropy(votes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entropy in nats of the votes on each message, from a long frame.

    Counted per (message, class) first, so a message with many votes is
    combined before it reaches one task.
    """
    counts = votes.groupBy(*key, "category").agg(F.count(F.lit(1)).alias("__n"))
    # H = ln N - sum(n ln n) / N needs only sums, hence no second look at N.
    n = F.col("__n").cast("double")
    total = F.sum(n)
    entropy = F.ln(total) - F.sum(n * F.ln(n)) / total
    return counts.groupBy(*key).agg(
        F.sum("__n").alias("votes"), F.greatest(entropy, F.lit(0.0)).alias("entropy")
    )


def consistency_entropy(resamples: DataFrame, key: Sequence[str], model: str = "model") -> DataFrame:
    """How unsettled a model is when asked repeatedly, in nats.

    Class counts of each message are ranked, averaged by rank over messages and
    normalised before the entropy. It is not a mean of entropies. The number of
    messages cancels when normalising.
    """
    counts = resamples.groupBy(model, *key, "category").agg(F.count(F.lit(1)).alias("__n"))
    # A group here is the classes of one message, never more than there are classes.
    by_count = Window.partitionBy(model, *key).orderBy(F.desc("__n"), "category")
    ranked = counts.withColumn("__rank", F.row_number().over(by_count))
    by_rank = ranked.groupBy(model, "__rank").agg(F.sum("__n").alias("__n"))
    share = F.col("__n").cast("double") / F.sum("__n").over(Window.partitionBy(model))
    return (
        by_rank.withColumn("__share", share)
        .groupBy(model)
        .agg((F.sum(entropy_term(F.col("__share"))) + F.lit(0.0)).alias("entropy"))
    )


def load_check(df: DataFrame, by: str = "model") -> DataFrame:
    """Inputs grouped by their number of rows: one line when all loaded alike."""
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("rows")
        .agg(F.count(F.lit(1)).alias("inputs"))
    )
