"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Each source's share of the tokens is raised to an exponent and normalised. An exponent
of 1 keeps the corpus as it is, 0 gives all sources the same weight. The exponent is
found by section search for a target entropy, or as the flattest mix that repeats no
source more often than a limit. A source's budget is spent in epochs. Every epoch is a
fresh permutation: of the source's blocks, and of the documents in each block. Whole
epochs take each document once. The last one stops at the document that meets the budget.

Documents belong to blocks by a hash, and a keyed bijection on block numbers ranks the blocks
of an epoch, so a row knows from its hashes alone where it stands and whether it is drawn. No
task sorts a source: block sizes are summed map-side, then those of the parts of the one
block that the last epoch stops in, and only the part that holds the end is sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.tables import columns_of
from tallymark.session import cut_lineage

#: Blocks of a source, a power of 4 for the bijection; a block in which an epoch stops is cut in as many parts.
HALF_BITS = 5
BLOCKS = 1 << 2 * HALF_BITS
#: Rounds of the bijection; four make it pseudorandom.
ROUNDS = 4
#: Epochs made by one array. Sources of more are dealt out over tasks in pieces of so many.
EPOCHS_AT_ONCE = 4096
#: Exponents tried in one pass over the sources; each pass narrows the range so many times.
SECTIONS = 16
PASSES = 8
#: Up to so many sources the per-source plan is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """What the mix aims at.

    ``entropy_share`` places the target entropy between that of the corpus (0) and that of equal
    weights (1). ``repeat_limit``, if given, is used in its place: the flattest mix in which no
    source is drawn more than so many times over. ``budget`` is in tokens; by default as many as
    the corpus has.
    """

    entropy_share: float = 0.5
    repeat_limit: float | None = None
    budget: int | None = None
    seed: int = 17


def count_words(text: Column) -> Column:
    """Words of a text; none of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _powers(sizes: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of powered shares, that sum weighted by log share, and the most epochs a source of weight 1 gets."""
    log_share = F.log(F.col("tokens") / F.lit(float(total)))
    columns = []
    for i, a in enumerate(exponents):
        power = F.exp(F.lit(a) * log_share)
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * log_share).alias(f"l{i}"), F.max(F.exp(F.lit(a - 1.0) * log_share)).alias(f"m{i}")]
    row = sizes.agg(*columns).first()
    return [(row[f"z{i}"], row[f"l{i}"], row[f"m{i}"]) for i in range(len(exponents))]


def find_exponent(sizes: DataFrame, total: int, budget: float, mix: Mix) -> float:
    """The exponent in [0, 1] that meets the mix's target; the nearer end if none does.

    ``sizes`` has one row per source with ``tokens`` above 0. Entropy falls, and so does the
    largest number of epochs, as the exponent grows.
    """
    (z0, l0, _), (z1, l1, _) = _powers(sizes, total, [0.0, 1.0])
    entropy = lambda a, z, l: math.log(z) - a * l / z
    if mix.repeat_limit is None:
        own, most = entropy(1.0, z1, l1), entropy(0.0, z0, l0)
        target = own + mix.entropy_share * (most - own)
        enough = lambda a, z, l, m: entropy(a, z, l) <= target
    else:
        enough = lambda a, z, l, m: m / z * budget / total <= mix.repeat_limit
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        found = [enough(a, *p) for a, p in zip(tried, _powers(sizes, total, tried))]
        first = found.index(True) if True in found else SECTIONS
        if first == 0:
            return tried[0]
        low, high = tried[first - 1], tried[first]
    return high


def _unit(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _rank(seed: int, key: Column, epoch: Column, block: Column) -> Column:
    """The place of a block in its epoch: a permutation of the block numbers by rounds that mix one half with a hash of the other."""
    left, right = F.shiftright(block, HALF_BITS), block.bitwiseAND((1 << HALF_BITS) - 1)
    shuffled = F.xxhash64(F.lit(seed), F.lit("block"), key, epoch)
    for turn in range(ROUNDS):
        mixed = F.xxhash64(shuffled, F.lit(turn), right).bitwiseAND((1 << HALF_BITS) - 1).cast("int")
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, HALF_BITS) + right


def _row_unit(seed: int, epoch: Column) -> Column:
    """The place of a document in its block, in [0, 1)."""
    return _unit(F.lit(seed), F.lit("row"), F.col("mix_order"), epoch)


def _reached(sizes: DataFrame, size: str, order: str, goal: str) -> DataFrame:
    """Of each key's parts the one in which the running total of ``size`` along ``order`` reaches ``goal``, with what is ``before``."""
    along = Window.partitionBy("mix_key").orderBy(order)
    return sizes.withColumn("before", F.sum(size).over(along) - F.col(size)).filter(f"before < {goal} and {goal} <= before + {size}")


def plan_mix(keyed: DataFrame, mix: Mix) -> DataFrame:
    """One row per source that has tokens: weight, budget, whole epochs, and where the last epoch stops.

    ``keyed`` has mix_key, mix_block, mix_order and mix_tokens. ``stop_rank`` and ``stop_order`` are null
    where no part of an epoch is left to draw.
    """
    # At most BLOCKS rows a source; read by every pass below.
    blocks = keyed.groupBy("mix_key", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")).filter("block_tokens > 0").persist()
    sizes = blocks.groupBy("mix_key").agg(F.sum("block_tokens").alias("tokens")).persist()
    try:
        total = sizes.agg(F.sum("tokens")).first()[0] or 0
        budget = float(total if mix.budget is None else mix.budget)
        exponent = find_exponent(sizes, total, budget, mix) if total else 1.0
        scale = _powers(sizes, total, [exponent])[0][0] if total else 1.0
        weight = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(max(total, 1))))) / F.lit(scale)
        plan = (
            sizes.withColumn("weight", weight)
            .withColumn("budget", F.round(F.col("weight") * F.lit(budget)).cast("long"))
            .withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        )
        ranked = blocks.join(plan.select("mix_key", "epochs", "rest"), "mix_key").withColumn(
            "stop_rank", _rank(mix.seed, F.col("mix_key"), F.col("epochs"), F.col("mix_block"))
        )
        stops = _reached(ranked, "block_tokens", "stop_rank", "rest").select(
            "mix_key", F.col("mix_block").alias("stop_block"), "stop_rank", F.col("epochs").alias("stop_epoch"), (F.col("rest") - F.col("before")).alias("goal")
        )
        # Ids and counts of under a thousandth of the documents; read twice.
        inside = cut_lineage(
            _with_plan(keyed, stops)
            .filter("mix_block = stop_block and mix_tokens > 0")
            .withColumn("stop_order", _row_unit(mix.seed, F.col("stop_epoch")))
            .select("mix_key", "stop_rank", "goal", F.floor(F.col("stop_order") * BLOCKS).cast("int").alias("part"), "stop_order", "mix_tokens")
        )
        parts = inside.groupBy("mix_key", "goal", "part").agg(F.sum("mix_tokens").alias("part_tokens"))
        last = _reached(parts, "part_tokens", "part", "goal").select("mix_key", "part", (F.col("goal") - F.col("before")).alias("goal"))
        # Documents of one place, equal in id and text, are drawn together.
        places = inside.drop("goal").join(last, ["mix_key", "part"]).groupBy("mix_key", "stop_rank", "goal", "stop_order").agg(F.sum("mix_tokens").alias("place_tokens"))
        cut = _reached(places, "place_tokens", "stop_order", "goal").select("mix_key", "stop_rank", "stop_order")
        # A few columns a source; read by the draw without the corpus passes above.
        return cut_lineage(plan.join(cut, "mix_key", "left"))
    finally:
        sizes.unpersist()
        blocks.unpersist()


def _with_plan(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows joined with their source's plan; the plan is broadcast if it was counted to be small."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return keyed.join(F.broadcast(plan) if small else plan, "mix_key")


def _each_epoch(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows once for every epoch that their source begins, in ``mix_epoch``; no array is longer than EPOCHS_AT_ONCE for 10^10 epochs."""
    begun = F.sequence(F.lit(0).cast("long"), F.col("epochs"))
    most = F.lit(EPOCHS_AT_ONCE)
    often = F.col("epochs") >= most
    # Rows and their order do not depend on this: it saves the second branch where no source repeats so often.
    if plan.filter(often).isEmpty():
        return drawn.withColumn("mix_epoch", F.explode(begun))
    pieces = (
        drawn.filter(often)
        .withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("epochs") / (most * most)))))
        .withColumn("piece", F.explode(F.sequence(F.col("outer") * most, F.least((F.col("outer") + 1) * most - 1, F.floor(F.col("epochs") / most)))))
    )
    tasks = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, F.xxhash64("mix_order", "piece"))
    late = dealt.withColumn("mix_epoch", F.explode(F.sequence(F.col("piece") * most, F.least((F.col("piece") + 1) * most - 1, F.col("epochs")))))
    return drawn.filter(~often).withColumn("mix_epoch", F.explode(begun)).unionByName(late.drop("outer", "piece"))


def draw(df: DataFrame, mix: Mix | None = None, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as often as they are drawn, in struct ``row``, with where each draw stands.

    ``mix_tokens`` (words), ``mix_epoch`` (from 0), ``mix_block``, ``mix_repeat`` (how many times over the
    source is drawn) and ``mix_at`` in [0, 1]: sorted by it, the sources run side by side at their weights,
    each block after block in its epoch's permutation. The last epoch is stretched to end at 1.
    A null source is a source of its own. Rows without words (null or empty text) have no share in a
    budget and are not drawn. Rows equal in id and text are drawn together. The last document
    of a source may pass its budget. An empty table draws nothing. A small source may be drawn very often
    where the mix has no ``repeat_limit``; its epochs are dealt out over tasks.
    """
    mix = mix or Mix()
    text, key = F.col(text_column), F.col(source_column)
    keyed = df.select(
        F.struct(*columns_of(df)).alias("row"),
        F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), key.cast("string"))).alias("mix_key"),
        F.xxhash64(F.col(id_column), text).alias("mix_order"),
        count_words(text).alias("mix_tokens"),
    ).withColumn("mix_block", F.pmod(F.xxhash64(F.lit(mix.seed), F.col("mix_order")), F.lit(BLOCKS)).cast("int"))
    plan = plan_mix(keyed.drop("row"), mix)
    drawn = _with_plan(keyed.filter("mix_tokens > 0"), plan)
    place = (F.col("rank") + F.col("row_unit")) / BLOCKS
    stop = (F.col("stop_rank") + F.col("stop_order")) / BLOCKS
    # The first place of all may be 0, and so may be the place to stop at.
    share = F.when(F.col("mix_epoch") < F.col("epochs"), place * F.col("tokens")).otherwise(F.when(stop > 0, place / stop).otherwise(0.0) * F.col("rest"))
    up_to_stop = (F.col("rank") < F.col("stop_rank")) | ((F.col("rank") == F.col("stop_rank")) & (F.col("row_unit") <= F.col("stop_order")))
    return (
        _each_epoch(drawn, plan)
        .withColumn("rank", _rank(mix.seed, F.col("mix_key"), F.col("mix_epoch"), F.col("mix_block")))
        .withColumn("row_unit", _row_unit(mix.seed, F.col("mix_epoch")))
        .filter((F.col("mix_epoch") < F.col("epochs")) | up_to_stop)
        .withColumn("mix_at", (F.col("mix_epoch") * F.col("tokens") + share) / F.col("budget"))
        .withColumn("mix_repeat", F.col("budget") / F.col("tokens"))
        .select("row", "mix_tokens", "mix_epoch", "mix_block", "mix_repeat", "mix_at")
    )


def mix_documents(df: DataFrame, mix: Mix | None = None, **columns: str) -> DataFrame:
    """The drawn rows of ``df`` with the columns of ``df`` alone, in the order of the mix.

    Places are even in [0, 1], so equal slices of it are the partitions, and files, one after the other.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = draw(df, mix, **columns)
    slice_ = F.least(F.floor(F.col("mix_at") * tasks), F.lit(tasks - 1)).cast("int")
    return drawn.repartitionById(tasks, slice_).sortWithinPartitions("mix_at").select("row.*")
