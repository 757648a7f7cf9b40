"""Similarity join of shingle sets by token-combination prefixes.

Order all shingles from rare to frequent. Two sets that reach the threshold miss so few
of each other's shingles that their prefixes must share one. For rare shingles that
makes a good index key. A frequent one (a shared passage, a large family of near copies)
would bring together too many documents, so frequent shingles are split into classes,
prefixes are extended, and k-combinations inside a class are indexed in place of single
shingles: a class of c shingles survives c - k misses. A prefix is long enough when
its classes together survive all misses the threshold allows.

The rest keeps the work linear. Documents with equal sets become one node. The nodes of a
large key are first compared with one of them, the hub, not with each other. Nodes linked
through hubs are one component already; pairs of different components that share a key,
large or small, are then generated, dropped if they share too few keys to link, and
verified, so no link between components is lost.

Frequencies come from counters of fixed size: they only set the order, any order is right.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import connected_components
from tallymark.llm.counters import add_up, pack
from tallymark.llm.tables import bound_batches, columns_of, slices
from tallymark.session import new_folder

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)
_THREE = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; documents link when ``100 * common >= percent * union``.

    ``counter_bits`` sizes the frequency counters (each 4 bytes, zipped) that every task sends
    and one byte each that is broadcast. A shingle whose counter stands ``frequent`` above what
    chance explains is indexed in pairs, ``very_frequent`` in triples. Keys of more than ``small``
    postings are compared through a hub first.
    """

    words: int = 4
    percent: int = 85
    counter_bits: int = 22
    frequent: int = 16
    very_frequent: int = 1024
    small: int = 16

    def misses(self, n: int) -> int:
        """Shingles of a set of ``n`` that may be missing from a set it links with."""
        return n - -(-n * self.percent // 100)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _TWO
    h = (h ^ (h >> np.uint64(27))) * _THREE
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, all words as one shingle if too few."""
    held = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not held:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, held)), np.uint64)
    width = min(words, len(hashes))
    rows = len(hashes) - width + 1
    folded = np.full(rows, width, np.uint64)
    for i in range(width):
        folded = mix(folded * _ONE + hashes[i : i + rows])
    return np.unique(folded)


def node_of(held: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set: the node's key and one to check it by."""
    digest = hashlib.blake2b(held.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _profile(df: DataFrame, join: Join, id_column: str, text_column: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of all rows, and the counters of every task in zipped parts; one pass, written to ``folder``."""
    size = 1 << join.counter_bits
    schema = "doc_id long, node long, checked long, n long, part int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint32)
        for batch in batches:
            for piece in slices(batch, 1):
                nodes, checks, sizes, drawn = [], [], [], []
                for text in piece.column(1).to_pylist():
                    held = shingles(text, join.words)
                    node, check = node_of(held) if len(held) else (None, None)
                    nodes.append(node)
                    checks.append(check)
                    sizes.append(len(held))
                    drawn.append(held)
                found = np.concatenate(drawn) >> np.uint64(64 - join.counter_bits)
                np.add.at(counters, found.astype(np.int64), 1)
                none = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                    ["doc_id", "node", "checked", "n", "part", "counts"],
                )
        held = pack(counters)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64())] * 4 + held.columns, ["doc_id", "node", "checked", "n", "part", "counts"])

    df.select(id_column, text_column).mapInArrow(run, schema).write.parquet(folder)
    read = df.sparkSession.read.schema(schema).parquet(folder)
    return read.filter("part is null").drop("part", "counts"), read.filter("part is not null").select("part", "counts")


def _levels(counts: DataFrame, join: Join) -> np.ndarray:
    """A byte per counter: 0 where its shingles are rare, else the logarithm of how far it stands out."""
    total = add_up(counts, 1 << join.counter_bits)
    mean = total.mean()
    above = (total - mean - 3 * np.sqrt(mean)) / join.frequent
    return np.where(above >= 1, np.floor(np.log2(np.maximum(above, 1))) + 1, 0).astype(np.uint8)


def _tags(n: int, join: Join) -> list[int]:
    """Size classes in which a set is indexed: two sets that link have one in common."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n >= join.percent * (1 << (own + 1)) else [own]


def signatures(held: np.ndarray, levels: np.ndarray, join: Join) -> tuple[np.ndarray, int, bool]:
    """Index keys of a set, how many of its shingles are rare, and whether the prefix goes past them.

    The low bit of a key is 1 for a single shingle, 0 for a combination.
    """
    n = len(held)
    level = levels[(held >> np.uint64(64 - join.counter_bits)).astype(np.int64)]
    order = np.lexsort((mix(held), level))
    held, level = held[order], level[order]
    rare = int(np.searchsorted(level, 1))
    need = join.misses(n) + 1
    singles, combined, deep = min(rare, need), [], False
    triple = int(np.log2(join.very_frequent / join.frequent)) + 1
    for tag in _tags(n, join):
        if tag <= 2:
            singles = max(singles, need)
            continue
        if rare >= need:
            continue
        deep = True
        classes = max(1, int((100 - join.percent) * (1 << tag) / 300))
        groups: dict[tuple[int, int], list[int]] = {}
        left = need - rare
        for shingle, high in zip(held[rare:].tolist(), (level[rare:] >= triple).tolist()):
            k = 3 if high else 2
            group = groups.setdefault((k, (shingle >> 8) % classes), [])
            group.append(shingle)
            if len(group) >= k:
                left -= 1
                if left == 0:
                    break
        for (k, _), group in groups.items():
            group.sort()
            for chosen in itertools.combinations(group, k):
                combined.append((tag, *chosen, *([0] * (3 - k))))
    one = np.uint64(1)
    keys = mix(held[:singles]) | one
    if combined:
        rows = np.array(combined, np.uint64)
        folded = np.zeros(len(rows), np.uint64)
        for i in range(4):
            folded = mix(folded * _ONE + rows[:, i])
        keys = np.concatenate([keys, folded & ~one])
    return keys, rare, deep


def _postings(df: DataFrame, levels: np.ndarray, join: Join, text_column: str) -> DataFrame:
    """Rows (``sig``, ``node``, ``meta``): keys of every set; a task gives those of equal sets once."""
    table = df.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for piece in slices(batch, 0, 4_000_000):
                keys, nodes, metas, sizes = [], [], [], []
                for text in piece.column(0).to_pylist():
                    held = shingles(text, join.words)
                    if not len(held):
                        continue
                    node, _ = node_of(held)
                    if node in seen:
                        continue
                    seen.add(node)
                    found, rare, deep = signatures(held, table.value, join)
                    keys.append(found)
                    sizes.append(len(found))
                    nodes.append(node)
                    metas.append(len(held) << 32 | rare << 1 | deep)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes)), pa.array(np.repeat(np.array(metas, np.int64), sizes))],
                        ["sig", "node", "meta"],
                    )

    return df.select(text_column).mapInArrow(run, "sig long, node long, meta long")


def _size(meta: str) -> Column:
    return F.shiftright(F.col(meta), 32)


def _rare(meta: str) -> Column:
    return F.shiftright(F.col(meta).bitwiseAND(F.lit(0xFFFFFFFF)), 1)


def _deep(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(1)) == 1


def _enough(common: Column, join: Join) -> Column:
    """Whether a pair with at most so many shingles in common can link."""
    return common * (100 + join.percent) >= join.percent * (_size("meta_a") + _size("meta_b"))


def _possible(shared_rare: Column, join: Join) -> Column:
    """Whether sizes, and rare shingles that the other set hasn't, leave room for a link.

    A prefix that goes past the rare shingles holds all of them, so of the rare ones two such
    sets have only ``shared_rare`` in common.
    """
    by_size = _enough(F.least(_size("meta_a"), _size("meta_b")), join)
    frequent = F.least(_size("meta_a") - _rare("meta_a"), _size("meta_b") - _rare("meta_b"))
    return by_size & (~(_deep("meta_a") & _deep("meta_b")) | _enough(frequent + shared_rare, join))


def _verified(df: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join, id_column: str, text_column: str) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes whose sets link, by their whole sets.

    ``nodes`` names a document for each node. Those needed are marked in a bit map of fixed
    size, so the pass over the documents builds few other sets; the join drops these.
    """
    spark = df.sparkSession
    bits = 23
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    # At most 2 ** 17 rows of 16 bytes.
    words = (
        wanted.join(nodes, "node")
        .select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("held"))
        .toPandas()
    )
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[words["word"].to_numpy(np.int64)] = words["held"].to_numpy(np.int64)
    marked = spark.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            hit = (marked.value[at >> 6] >> (at & 63)) & 1
            batch = batch.filter(pa.array(hit.astype(bool)))
            for piece in slices(batch, 1, 4_000_000):
                held = [h for text in piece.column(1).to_pylist() if len(h := shingles(text, join.words))]
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node_of(h)[0] for h in held], pa.int64()), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))],
                        ["node", "held"],
                    )

    # Nodes hold their documents as long: an int hashes otherwise.
    ids = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column))
    sets = ids.select(place, text_column).mapInArrow(run, "node long, held array<long>")
    sets = sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))
    folder = new_folder(spark, "sets")
    sets.write.parquet(folder)
    sets = spark.read.schema("node long, held array<long>").parquet(folder)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
    common = F.size(F.array_intersect("held_a", "held_b"))
    union = F.size("held_a") + F.size("held_b") - common
    return both.filter(F.lit(100) * common >= F.lit(join.percent) * union).select("a", "b")


def link_documents(df: DataFrame, join: Join | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest id reachable by links, the row's own included. A null or empty
    text, or one without words, has 0 shingles and links with nothing. Rows with equal sets link,
    so do repeated rows. Null ids stay null and name no component but their own. Further
    columns are left out; an empty table gives none.
    """
    join = join or Join()
    spark = df.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "shingles")
    rows, counts = _profile(df, join, id_column, text_column, f"{folder}/rows")
    levels = _levels(counts, join)
    clash = F.when(F.min("checked") < F.max("checked"), F.raise_error(F.lit("two sets have one 64-bit digest"))).otherwise(F.min("doc_id"))
    nodes = rows.filter("node is not null").groupBy("node").agg(clash.alias("doc_id"))
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema("node long, doc_id long").parquet(f"{folder}/nodes")

    _postings(df, levels, join, text_column).write.parquet(f"{folder}/postings")
    postings = spark.read.schema("sig long, node long, meta long").parquet(f"{folder}/postings")
    # The hub has the fewest rare shingles: in a family of near copies the one next to most others.
    central = F.struct(_rare("meta").alias("rare"), F.col("node").alias("hub"), F.col("meta").alias("meta_hub"))
    hubs = (
        postings.groupBy("sig")
        .agg(F.min(central).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("held"))
        .filter("low < high")
        .withColumn("hub", F.when(F.col("held") > join.small, F.col("hub")))
        .select("sig", "hub.hub", "hub.meta_hub")
    )
    postings.join(hubs, "sig").write.parquet(f"{folder}/shared")
    shared = spark.read.schema("sig long, node long, meta long, hub long, meta_hub long").parquet(f"{folder}/shared")

    first = (
        shared.filter("node <> hub")
        .select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("meta").alias("meta_a"), F.col("meta_hub").alias("meta_b"), (F.col("sig").bitwiseAND(F.lit(1)) == 1).alias("single"))
        .filter(_possible(F.when(F.col("single"), F.least(_rare("meta_a"), _rare("meta_b"))).otherwise(F.lit(0)), join))
        .select("a", "b")
        .distinct()
    )
    first.write.parquet(f"{folder}/first")
    first = spark.read.schema("a long, b long").parquet(f"{folder}/first")
    _verified(df, first, nodes, join, id_column, text_column).write.parquet(f"{folder}/links1")
    links = spark.read.schema("a long, b long").parquet(f"{folder}/links1")
    parts = connected_components(links)

    # Second step: keys whose nodes are not all of one component.
    placed = shared.select("sig", "node", "meta").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("sig")
    # A node's key may come from several tasks.
    placed = placed.join(mixed, "sig").groupBy("sig", "node").agg(F.min("meta").alias("meta"), F.min("component").alias("component"))
    placed.write.parquet(f"{folder}/mixed")
    placed = spark.read.schema("sig long, node long, meta long, component long").parquet(f"{folder}/mixed")
    a = placed.select("sig", F.col("node").alias("a"), F.col("meta").alias("meta_a"), F.col("component").alias("component_a"))
    b = placed.select("sig", F.col("node").alias("b"), F.col("meta").alias("meta_b"), F.col("component").alias("component_b"))
    single = F.col("sig").bitwiseAND(F.lit(1)) == 1
    # Pairs that share a single key are found by it; by a combination only those that share none need be.
    near = (a["sig"] == b["sig"]) & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
    room = F.when(a["sig"].bitwiseAND(F.lit(1)) == 1, F.least(_rare("meta_a"), _rare("meta_b"))).otherwise(F.lit(0))
    pairs = (
        a.join(b, near & _possible(room, join))
        .select(a["sig"], "a", "b", "meta_a", "meta_b")
        .groupBy("a", "b", "meta_a", "meta_b")
        .agg(F.sum(F.when(single, 1).otherwise(0)).alias("singles"))
    )
    # A prefix of single shingles alone: beyond it at most the rest of the set is common.
    need = lambda meta: _size(meta) - F.ceil(_size(meta) * join.percent / 100) + 1
    most = F.greatest(F.col("singles") + _size("meta_a") - need("meta_a"), F.col("singles") + _size("meta_b") - need("meta_b"))
    shallow = ~_deep("meta_a") & ~_deep("meta_b")
    second = pairs.filter(_possible(F.col("singles"), join) & (~shallow | _enough(most, join))).select("a", "b").join(first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    second.write.parquet(f"{folder}/second")
    second = spark.read.schema("a long, b long").parquet(f"{folder}/second")
    if not second.isEmpty():
        _verified(df, second, nodes, join, id_column, text_column).write.parquet(f"{folder}/links2")
        links = links.unionByName(spark.read.schema("a long, b long").parquet(f"{folder}/links2"))
        parts = connected_components(links)

    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = named.join(least, "component").select("node", "component_id")
    return rows.join(member, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, join: Join | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each component: the one of the smallest id, columns as they were.

    Rows of one id are one document; of repeated ones the row with the smallest text hash
    stays. Documents without words are not alike and stay, as do rows without an id.
    """
    found = link_documents(df, join, id_column, text_column)
    folder = new_folder(df.sparkSession, "components")
    found.write.parquet(folder)
    found = df.sparkSession.read.schema(found.schema).parquet(folder)
    kept = found.filter("doc_id = component_id").groupBy("doc_id").count()
    repeated = not kept.filter("count > 1").isEmpty()
    # Merged at every size: the list of kept ids grows with the corpus and is no side to broadcast.
    rows = df.join(kept.select(F.col("doc_id").alias(id_column)).hint("merge"), id_column, "left_semi").select(*columns_of(df))
    if repeated:
        row = F.struct(*columns_of(df))
        first = F.min_by(row, F.xxhash64(text_column))
        rows = rows.groupBy(F.col(id_column).alias("kept_id")).agg(first.alias("kept_row")).select("kept_row.*")
    return rows.unionByName(df.filter(F.col(id_column).isNull()))
