"""Near duplicates by MinHash with tensored banding.

A table key of plain banding takes its own minhashes, so many tables need many hashes. Here one small
collection of ``subs`` sub-signatures, of ``width`` minhashes each, makes all keys: a table is a pair of them, and
two documents share a key when they agree in any two sub-signatures. ``subs * width`` minhashes
serve ``subs * (subs - 1) / 2`` tables of ``2 * width`` minhashes, about the square root of what separate tables would compute.

Both numbers follow from the rows: ``width`` grows with their logarithm, so that unrelated documents share few
sub-signatures, and ``subs`` keeps the chance that two documents right at the threshold share no key
under ``miss``. Candidates are verified on their whole sets.

The work stays linear. Documents with equal sets are one node. A sub-signature that only one node has makes no
key. Nodes first vote for the hub of each sub-signature that they share, the node with most company; two votes for
one hub are a common table key, and the best hub of a node is verified. Keys are written out only for what is
left: sub-signatures shared by nodes of different components. Of these, blocks of nodes that voted alike meet if they
have a key in common, and all pairs of different components that agree twice are verified inside; no pairs are
written, and no candidate is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import connected_components
from tallymark.llm.shingle_join import mix, node_of, shingles
from tallymark.llm.tables import bound_batches, slices
from tallymark.session import new_folder

_ONE = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a set that are hashed at a time.
STEP = 2048
#: Places of the widest bit map, 32 MB, that marks documents whose sets are needed. Beyond some ten million of them more
#: sets are built than needed; the join drops these.
MOST_PLACES = 28
#: Shingles and nodes of a block, nearly; two blocks meet in one task.
BLOCK_SHINGLES, BLOCK_NODES = 500_000, 1_000


@dataclass(frozen=True)
class Tables:
    """``subs`` sub-signatures of ``width`` minhashes; a table for each two of them."""

    width: int
    subs: int

    def misses(self, similarity: float) -> float:
        """The chance that two sets of this similarity agree in less than two sub-signatures."""
        p = similarity**self.width
        return (1 - p) ** self.subs + self.subs * p * (1 - p) ** (self.subs - 1)


@dataclass(frozen=True)
class Near:
    """Shingles of ``words`` words; documents link when ``100 * common >= percent * union``.

    ``unrelated`` is the similarity that unrelated documents are taken to have, which only sets the cost; ``miss`` the
    chance, at the threshold itself, that a pair is no candidate.
    """

    words: int = 2
    percent: int = 80
    unrelated: float = 0.05
    miss: float = 1e-6

    def tables(self, rows: int) -> Tables:
        """Widths at which a document shares a sub-signature with a quarter of an unrelated one, and enough of them."""
        width = max(2, math.ceil(math.log(max(4 * rows, 1)) / -math.log(self.unrelated)))
        subs = 2
        while Tables(width, subs).misses(self.percent / 100) > self.miss:
            subs += 1
        return Tables(width, subs)


def multipliers(count: int) -> np.ndarray:
    """Odd numbers by which shingles' hashes are multiplied: each gives an order of all shingles."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _ONE) | np.uint64(1)


def minhashes(held: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product of a set's hashes with each factor."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(held), STEP):
        least = np.minimum(least, (held[start : start + STEP, None] * factors).min(axis=0))
    return least


def sub_signatures(least: np.ndarray, tables: Tables) -> np.ndarray:
    """Rows of minhashes folded to one number for each sub-signature; its place is part of it."""
    parts = least.reshape(len(least), tables.subs, tables.width)
    folded = np.tile(np.arange(1, tables.subs + 1, dtype=np.uint64), (len(least), 1))
    for i in range(tables.width):
        folded = mix(folded * _ONE + parts[:, :, i])
    return folded


_ROWS = "doc_id long, node long, checked long, n long, subs array<long>"


def _profile(ids: DataFrame, near: Near, tables: Tables) -> DataFrame:
    """Node, set size and sub-signatures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(tables.subs * tables.width)
        for batch in batches:
            for piece in slices(batch, 1):
                sets = [shingles(text, near.words) for text in piece.column(1).to_pylist()]
                nodes = [node_of(held) if len(held) else (None, None) for held in sets]
                least = [minhashes(held, factors) for held in sets if len(held)]
                found = iter(sub_signatures(np.array(least), tables).view(np.int64)) if least else iter(())
                subs = [next(found) if len(held) else None for held in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([a for a, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(subs, pa.list_(pa.int64()))],
                    ["doc_id", "node", "checked", "n", "subs"],
                )

    return ids.mapInArrow(run, _ROWS)


def _fit(near: Near, a: str = "n_a", b: str = "n_b") -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= near.percent * F.greatest(a, b)


def _marks(wanted: DataFrame, place: Column, places: int) -> np.ndarray:
    """A bit for each place that a wanted document has: at most ``2 ** (MOST_PLACES - 6)`` rows of 16 bytes."""
    rows = (
        wanted.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("held"))
        .toPandas()
    )
    marks = np.zeros(max(1, places >> 6), np.int64)
    marks[rows["word"].to_numpy(np.int64)] = rows["held"].to_numpy(np.int64)
    return marks


def _sets(ids: DataFrame, wanted: DataFrame, nodes: DataFrame, near: Near, folder: str) -> DataFrame:
    """``node``, ``left``, ``right`` and ``held``, the whole set, of the nodes in ``wanted`` (``node``, ``side``: 1 left, 2 right, 3 both).

    One pass over the documents, which builds the sets of those that a bit map of a size by their number marks.
    """
    spark = ids.sparkSession
    schema = "node long, left boolean, right boolean, held array<long>"
    wanted.join(nodes.select("node", "doc_id"), "node").write.parquet(f"{folder}/wanted")
    wanted = spark.read.schema("node long, side int, doc_id long").parquet(f"{folder}/wanted")
    count = wanted.count()
    places = 1 << min(max((16 * count).bit_length(), 16), MOST_PLACES)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(places))
    shared = spark.sparkContext.broadcast([_marks(wanted.filter(F.col("side").bitwiseAND(F.lit(side)) > 0), place, places) for side in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            left, right = (((marks[at >> 6] >> (at & 63)) & 1).astype(bool) for marks in shared.value)
            kept = pa.RecordBatch.from_arrays([batch.column(1), pa.array(left), pa.array(right)], ["text", "left", "right"]).filter(pa.array(left | right))
            for piece in slices(kept, 0, 4_000_000):
                rows = []
                for text, is_left, is_right in zip(*(c.to_pylist() for c in piece.columns)):
                    held = shingles(text, near.words)
                    if not len(held) or (node := node_of(held)[0]) in seen:
                        continue
                    seen.add(node)
                    rows.append((node, is_left, is_right, held.view(np.int64)))
                if rows:
                    nodes, lefts, rights, sets = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lefts), pa.array(rights), pa.array(list(sets), pa.list_(pa.int64()))], ["node", "left", "right", "held"])

    ids.select(place, "text").mapInArrow(run, schema).write.parquet(f"{folder}/sets")
    sets = spark.read.schema(schema).parquet(f"{folder}/sets")
    # A repeated row, of one id and text, gives its set once a task.
    if sets.select("node").join(wanted.select("node"), "node", "left_semi").count() > count:
        sets = sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("left", "right", "held")))
    return sets


def _verified(ids: DataFrame, pairs: DataFrame, nodes: DataFrame, near: Near, folder: str) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes whose sets link, by their whole sets."""
    sides = pairs.select(F.col("a").alias("node"), F.lit(1).alias("side")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(2).alias("side")))
    sets = _sets(ids, sides.groupBy("node").agg(F.bit_or("side").alias("side")), nodes, near, folder)
    side = lambda name, column: sets.filter(name).select(F.col("node").alias(column), F.col("held").alias(f"held_{column}"))
    both = pairs.join(side("left", "a"), "a").join(side("right", "b"), "b")
    common = F.size(F.array_intersect("held_a", "held_b"))
    union = F.size("held_a") + F.size("held_b") - common
    both.filter(100 * common.cast("long") >= near.percent * union.cast("long")).select("a", "b").write.parquet(f"{folder}/links")
    return ids.sparkSession.read.schema("a long, b long").parquet(f"{folder}/links")


def links_within(left: pa.Table, right: pa.Table, near: Near, same: bool) -> list[tuple[int, int]]:
    """Links between nodes of different components that agree in two sub-signatures, by their whole sets."""

    def columns(rows: pa.Table) -> tuple:
        numbers = (rows.column(c).to_numpy() for c in ("node", "n", "component"))
        held = rows.column("held").combine_chunks()
        subs = rows.column("subs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        return *numbers, subs, held.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())])

    nodes_a, sizes_a, parts_a, subs_a, held_a, starts_a = columns(left)
    nodes_b, sizes_b, parts_b, subs_b, held_b, starts_b = columns(right)
    found = []
    for i, node in enumerate(nodes_a):
        least, most = np.minimum(sizes_b, sizes_a[i]), np.maximum(sizes_b, sizes_a[i])
        open_still = (parts_b != parts_a[i]) & (100 * least >= near.percent * most)
        if same:
            open_still &= nodes_b > node
        chosen = np.flatnonzero(open_still)
        chosen = chosen[(subs_b[chosen] == subs_a[i]).sum(axis=1) >= 2]
        if not len(chosen):
            continue
        own = held_a[starts_a[i] : starts_a[i + 1]]
        others = np.concatenate([held_b[starts_b[j] : starts_b[j + 1]] for j in chosen])
        at = np.minimum(np.searchsorted(own, others), len(own) - 1)
        common = np.add.reduceat((own[at] == others).astype(np.int64), np.concatenate([[0], np.cumsum(sizes_b[chosen])[:-1]]))
        linked = 100 * common >= near.percent * (sizes_a[i] + sizes_b[chosen] - common)
        found += [(int(node), int(other)) for other in nodes_b[chosen[linked]]]
    return found


def _rest(ids: DataFrame, nodes: DataFrame, shared: DataFrame, first: DataFrame, parts: DataFrame, near: Near, folder: str) -> DataFrame:
    """Links between nodes of different components that have a table key in common.

    Nodes whose votes hang together stand together in blocks of bounded size. Blocks that share a key of nodes of
    different components meet in one group each; their nodes are compared there and only links come out.
    """
    spark = ids.sparkSession
    placed = shared.select("sub", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed.write.parquet(f"{folder}/placed")
    placed = spark.read.schema("node long, sub long, component long").parquet(f"{folder}/placed")
    several = lambda rows, key: rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(key)
    lists = (
        placed.join(several(placed, "sub"), "sub")
        .groupBy("node", "component")
        # No more than there are sub-signatures.
        .agg(F.sort_array(F.collect_set("sub")).alias("subs"))
        .filter(F.size("subs") >= 2)
    )
    later = lambda x, i: F.transform(F.slice("subs", i + 2, F.size("subs")), lambda y: F.xxhash64(x, y))
    lists.select("node", "component", F.explode(F.flatten(F.transform("subs", later))).alias("key")).write.parquet(f"{folder}/keys")
    keys = spark.read.schema("node long, component long, key long").parquet(f"{folder}/keys")
    keys = keys.join(several(keys, "key"), "key")
    # Votes make trees: a hub has voted for another one. Who has no vote goes with the largest key it has.
    heads = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("head"))
    voteless = keys.join(first.select(F.col("a").alias("node")), "node", "left_anti").join(heads, "key")
    joined = voteless.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("size", "head"))["head"].alias("b"))
    families = connected_components(first.unionByName(joined)).withColumnRenamed("component", "family")
    crowd = keys.select("node", "component").distinct().join(families, "node", "left")
    crowd = crowd.withColumn("family", F.coalesce("family", "node")).join(nodes.select("node", "n", "subs"), "node")
    crowd.write.parquet(f"{folder}/crowd")
    crowd = spark.read.schema("node long, component long, family long, n long, subs array<long>").parquet(f"{folder}/crowd")
    if crowd.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    room = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES))
    blocks = crowd.groupBy("family").agg(room.alias("room"))
    part = F.pmod(F.xxhash64("node"), "room")
    crowd = crowd.join(blocks, "family").withColumn("block", F.xxhash64("family", part)).drop("family", "room")

    held = keys.join(crowd.select("node", "block"), "node").select("key", "block").distinct()
    met = held.select("key", F.col("block").alias("low")).join(held.select("key", F.col("block").alias("high")), "key")
    met.filter("low <= high").select("low", "high").distinct().write.parquet(f"{folder}/met")
    met = spark.read.schema("low long, high long").parquet(f"{folder}/met")
    sets = _sets(ids, crowd.select("node", F.lit(1).alias("side")), nodes, near, folder)
    crowd.join(sets.select("node", "held"), "node").write.parquet(f"{folder}/blocks")
    rows = spark.read.schema("node long, component long, n long, subs array<long>, block long, held array<long>").parquet(f"{folder}/blocks")
    at = lambda side, pairs: rows.join(pairs.withColumn("block", F.col(side)), "block").drop("block").withColumn("side", F.lit(side))
    both = at("low", met).unionByName(at("high", met.filter("low < high")))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        left, right = (group.filter(pc.equal(group.column("side"), side)) for side in ("low", "high"))
        same = key[0].as_py() == key[1].as_py()
        found = links_within(left, left if same else right, near, same)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    both.groupBy("low", "high").applyInArrow(run, "a long, b long").write.parquet(f"{folder}/links")
    return spark.read.schema("a long, b long").parquet(f"{folder}/links")


def link_documents(df: DataFrame, near: Near | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id reachable by links, the row's own included, and ``kept`` whether that is the
    row itself. A null or empty text, or one without words, has 0 shingles and links with nothing. Rows with
    equal sets link, so do repeated rows. Null ids stay null and name no component but their own. Two sets of
    one 64-bit digest stop the job. Further columns are left out; an empty table gives no rows.
    """
    near = near or Near()
    spark = df.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "near")
    ids = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    tables = near.tables(df.count())
    _profile(ids, near, tables).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/rows")
    clash = F.when(F.min("checked") < F.max("checked"), F.raise_error(F.lit("two sets have one 64-bit digest"))).otherwise(F.min("doc_id"))
    held = rows.filter("node is not null").groupBy("node").agg(clash.alias("doc_id"), F.first("n").alias("n"), F.first("subs").alias("subs"))
    held.write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema("node long, doc_id long, n long, subs array<long>").parquet(f"{folder}/nodes")

    # Sub-signatures that two nodes have.
    each = nodes.select("node", "n", F.explode("subs").alias("sub"))
    company = each.groupBy("sub").agg(F.count("*").alias("size")).filter("size > 1")
    each.join(company, "sub").write.parquet(f"{folder}/shared")
    shared = spark.read.schema("sub long, node long, n long, size long").parquet(f"{folder}/shared")
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("sub").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    votes = (
        shared.join(hubs, "sub")
        .filter(F.col("node") != F.col("hub.node"))
        .select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count("*").alias("votes"))
        .filter((F.col("votes") >= 2) & _fit(near))
    )
    votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")).write.parquet(f"{folder}/first")
    first = spark.read.schema("a long, b long").parquet(f"{folder}/first")
    links = _verified(ids, first, nodes, near, f"{folder}/one")
    parts = connected_components(links)

    more = _rest(ids, nodes, shared, first, parts, near, f"{folder}/two")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    named = nodes.select("node", "doc_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = named.join(least, "component").select("node", "component_id")
    found = rows.select("doc_id", "node", "n").join(member, "node", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
