"""Comparing cluster labelings and checking vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    same = F.avg((F.col(first) == F.col(second)).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("rows"), same.alias("agreement"))


def match_clusters(df: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of clusters that are each other's largest overlap.

    Works on the contingency counts, whose size depends on the cluster numbers only.
    """
    counts = contingency(df, first, second)
    by_first = Window.partitionBy(first).orderBy(F.desc("n"), second)
    by_second = Window.partitionBy(second).orderBy(F.desc("n"), first)
    return (
        counts.withColumn("__a", F.row_number().over(by_first))
        .withColumn("__b", F.row_number().over(by_second))
        .filter((F.col("__a") == 1) & (F.col("__b") == 1))
        .select(first, second, "n")
    )


def relabel(df: DataFrame, first: str, second: str) -> DataFrame:
    """``second`` renamed to the matching ``first`` cluster; null where none matches."""
    pairs = match_clusters(df, first, second).select(second, F.col(first).alias("__matched"))
    return df.join(pairs, second, "left").withColumn(second, F.col("__matched")).drop("__matched")


def vectors_differ(df: DataFrame, vector: str, key: str, tolerance: float = 1e-8) -> DataFrame:
    """Largest distance of any element from the first vector, and whether all are equal.

    The first vector is a scalar subquery; every row folds its own vector, so
    nothing is exploded.
    """
    first = df.agg(F.min_by(vector, key).alias("v")).scalar()
    gap = F.array_max(
        F.zip_with(vector, "__first", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    )
    return df.select(vector, first.alias("__first")).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.max(gap).alias("largest_gap"),
        (F.max(gap) <= tolerance).alias("all_equal"),
    )
