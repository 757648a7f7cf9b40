"""Exact global and per-group positions without a single-task window.

``row_number`` over a whole frame, or over one hot group, sorts it in one task.
Here rows fall into buckets that follow the wanted order; a small table of
bucket sizes gives each bucket the number of rows before it, and ``row_number``
only runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.keys import hash_prefix, order_hash
from tallymark.functions.numbers import value_bucket


def _partition(columns: Sequence[str]):
    return Window.partitionBy(*(columns or [F.lit(0)]))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match, keeping the left columns once."""
    renamed = right.withColumnsRenamed({name: f"__r_{name}" for name in on})
    condition = F.lit(True)
    for name in on:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__r_{name}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{name}" for name in on])


def rows_before(sizes: DataFrame, group: Sequence[str], levels: Sequence[str], size: str) -> DataFrame:
    """Add ``__before`` and ``__all``: rows in earlier buckets, and in all, of the same group.

    ``levels`` are nested buckets, coarse to fine, each sorted inside the one
    above it. Running totals are taken level by level, so one window partition
    holds only the buckets that share a parent.
    """
    result = None
    for depth in range(len(levels)):
        parents = [*group, *levels[:depth]]
        here = [*parents, levels[depth]]
        totals = sizes
        if depth < len(levels) - 1:
            totals = sizes.groupBy(*here).agg(F.sum(size).alias(size))
        earlier = (
            _partition(parents)
            .orderBy(levels[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = totals.withColumn(
            f"__before{depth}", F.coalesce(F.sum(size).over(earlier), F.lit(0).cast("bigint"))
        )
        if depth == 0:
            step = step.withColumn("__all", F.sum(size).over(_partition(group)))
        if depth < len(levels) - 1:
            step = step.drop(size)
        result = step if result is None else join_null_safe(step, result, parents)
    total = sum((F.col(f"__before{depth}") for depth in range(len(levels))), F.lit(0).cast("bigint"))
    return result.withColumn("__before", total).drop(
        *[f"__before{depth}" for depth in range(len(levels))]
    )


def with_position(
    df: DataFrame,
    *,
    order: Sequence[Column],
    levels: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
    wanted: Callable[[Column, Column, Column], Column] | None = None,
    few_buckets: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row in its group, and its size as ``total``.

    Each level must be non-decreasing along ``order`` within the level above,
    and ``order`` must end in something unique. The last level should split
    ties evenly, e.g. a prefix of an order hash.

    ``wanted`` takes (first position, position after the last, group size) of a
    bucket and says whether its rows are needed. The others are dropped before
    anything is sorted. The buckets kept are sent to all tasks: there are at
    most as many as wanted positions. ``few_buckets`` says that the caller
    bounds the number of buckets.
    """
    group = list(group)
    names = [f"__level{i}" for i in range(len(levels))]
    bucketed = df.withColumns(dict(zip(names, levels)))
    sizes = bucketed.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("__size"))
    offsets = rows_before(sizes, group, names, "__size")
    if wanted is not None:
        before, size = F.col("__before"), F.col("__size")
        offsets = offsets.filter(wanted(before, before + size, F.col("__all")))
    offsets = offsets.drop("__size")
    if wanted is not None or few_buckets:
        offsets = F.broadcast(offsets)
    # Buckets first: they tell rows apart sooner than a group does, so sorting
    # and hashing are cheaper when one group is large.
    inside = F.row_number().over(Window.partitionBy(*reversed(names), *group).orderBy(*order))
    out = join_null_safe(bucketed, offsets, [*group, *names]).withColumn("__inside", inside)
    out = out.withColumn(name, F.col("__before") + F.col("__inside") - F.lit(1))
    if total is not None:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__before", "__inside", "__all", *names)


def with_random_position(
    df: DataFrame,
    key: str,
    seed: int,
    *,
    group: Sequence[str] = (),
    name: str = "position",
    digits: int = 3,
) -> DataFrame:
    """Position in a seeded shuffle; ``key`` must be unique per row.

    Hash prefixes split even a hot group into ``16 ** digits`` equal buckets.
    """
    hashed = df.withColumn("__hash", order_hash(key, seed))
    return with_position(
        hashed,
        order=[F.col("__hash"), F.col(key)],
        levels=[hash_prefix(F.col("__hash"), digits)],
        group=group,
        name=name,
        few_buckets=not group and digits <= 4,
    ).drop("__hash")


def chunk_number(position: str | Column, rows: int) -> Column:
    """Fixed-size chunks of an ordered frame."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(rows)).cast("bigint")


def with_chunk_by_value(
    df: DataFrame, value: str, key: str, rows: int, *, seed: int = 0, name: str = "chunk"
) -> DataFrame:
    """Chunk a frame sorted by a whole-number column (e.g. token counts).

    Ties, which may hold a large share of the rows, are ordered and split by hash.
    """
    hashed = df.withColumn("__hash", order_hash(key, seed))
    placed = with_position(
        hashed,
        order=[F.col(value), F.col("__hash"), F.col(key)],
        # Coarse buckets first: how many there are does not grow with the data.
        levels=[value_bucket(F.col(value)), F.col(value), hash_prefix(F.col("__hash"))],
        name="__position",
    )
    return placed.withColumn(name, chunk_number("__position", rows)).drop("__hash", "__position")


def with_chunk_by_time(
    df: DataFrame, moment: str, key: str, rows: int, *, seed: int = 0, name: str = "chunk"
) -> DataFrame:
    """Chunk a frame sorted by a timestamp: day, then second, then exact time, then hash."""
    hashed = df.withColumn("__hash", order_hash(key, seed))
    micros = F.unix_micros(F.col(moment))
    day = F.floor(micros / F.lit(86_400_000_000)).cast("bigint")
    placed = with_position(
        hashed,
        order=[micros, F.col("__hash"), F.col(key)],
        levels=[day, F.floor(micros / F.lit(1_000_000)).cast("bigint"), micros, hash_prefix(F.col("__hash"))],
        name="__position",
    )
    return placed.withColumn(name, chunk_number("__position", rows)).drop("__hash", "__position")


def top_n(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    spread: int = 64,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group; ``order`` must be total.

    Spark limits each input partition to ``n`` rows per group before the
    shuffle. The survivors of a hot group are then cut down in ``spread`` tasks
    before the last one sees at most ``n * spread`` of them.
    """
    part = df.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(spread)))
    by_part = Window.partitionBy(*group, "__part").orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    kept = (
        part.withColumn("__rank", F.row_number().over(by_part))
        .filter(F.col("__rank") <= n)
        .drop("__part")
        .withColumn("__rank", F.row_number().over(by_group))
        .filter(F.col("__rank") <= n)
    )
    return kept.withColumnRenamed("__rank", rank) if rank else kept.drop("__rank")
