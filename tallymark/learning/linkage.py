"""Average linkage by cosine distance, in rounds of reciprocal nearest neighbours.

The mean distance of two clusters is 1 less the inner product of their mean unit vectors, so a cluster is its sum and its
number of rows. Two clusters that are each other's nearest are merged in any order of merging, so each round merges
all of them. A merged cluster is never nearer to a third than both its parts were, so only clusters that were merged, or whose nearest
was, are compared again. Where these are many, chunks of them meet chunks of all clusters in tasks of bounded size. Where they are
few, the driver holds them and what their merges change: a round is then two passes over a table that stays as it is until so many
changes are held. A few last clusters are merged on the driver. Merges are ordered by their distance at the end, and the highest left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.session import new_folder

#: Clusters that the driver merges.
LAST = 256
#: Clusters of a chunk that meets all others, and of pieces of two chunks that are compared at a time.
CHUNK_ROWS, PIECE_ROWS, AGAINST_ROWS = 16384, 256, 4096
#: Clusters that a round of the driver compares, and that may differ from the table, at most; rows of a task of its passes.
FEW, PASS_ROWS = 8192, 65536

#: ``total`` holds doubles; ``other`` is the nearest cluster, at ``height``, or the cluster itself while that is not known.
_CLUSTERS = "head long, total binary, n long, other long, height double"
_MERGES = "child long, parent long, height double, round int"


def _units(rows: DataFrame) -> DataFrame:
    """Unit vectors (``total``) of the vectors ``v``; a vector of zeros stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(held, axis=1, keepdims=True)
            units = np.divide(held, norms, out=np.zeros_like(held), where=norms > 0)
            # Vectors that differ by rounding alone are one.
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(np.round(units, 12) + 0.0)], ["row", "total"])

    return rows.mapInArrow(run, "row long, total binary")


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(rows, np.float64)], pa.binary())


def _unpacked(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1)


def _means(batch: pa.RecordBatch) -> np.ndarray:
    """Of the columns ``total`` and ``n``, at 1 and 2."""
    return _unpacked(batch.column(1), batch.num_rows) / batch.column(2).to_numpy()[:, None]


def _found(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ordered`` and in ``wanted`` of the numbers that both have."""
    at = np.searchsorted(ordered, wanted)
    there = np.flatnonzero(at < len(ordered))
    there = there[ordered[at[there]] == wanted[there]]
    return at[there], there


def _best(heads: np.ndarray, means: np.ndarray, all_heads: np.ndarray, all_means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest inner product of each cluster with another one, and its place: of equal ones the first; -inf if there is no other."""
    inner, place = np.full(len(heads), -np.inf), np.zeros(len(heads), np.int64)
    order = np.argsort(all_heads, kind="stable")
    for start in range(0, len(heads) if len(all_heads) else 0, PIECE_ROWS):
        mine = slice(start, start + PIECE_ROWS)
        at, there = _found(all_heads[order], heads[mine])
        for first in range(0, len(all_heads), AGAINST_ROWS):
            table = means[mine] @ all_means[first : first + AGAINST_ROWS].T
            own = order[at] - first
            same = (own >= 0) & (own < table.shape[1])
            table[there[same], own[same]] = -np.inf
            far = table.argmax(axis=1)
            most = table[np.arange(len(far)), far]
            more = most > inner[mine]
            inner[mine][more], place[mine][more] = most[more], far[more] + first
    return inner, place


def _nearest(clusters: DataFrame, asked: int, count: int) -> DataFrame:
    """The nearest other cluster of those (``head``, ``other``, ``height``) for which it is not known; the smallest head of equally near ones."""
    mine, theirs = -(-asked // CHUNK_ROWS), -(-count // CHUNK_ROWS)

    def chunks(rows: DataFrame, number: int, side: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads, means = batch.column(0).to_numpy(), _means(batch)
                parts = [(c, heads[heads % number == c].tobytes(), means[heads % number == c].tobytes()) for c in np.unique(heads % number).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "heads", "means"])

        held = rows.select("head", "total", "n").mapInArrow(run, "chunk long, heads binary, means binary").withColumn("side", F.lit(side))
        # The number of a pair of chunks: every chunk meets all of the other side.
        first, step, last = ("chunk", mine, F.col("chunk") + mine * (theirs - 1)) if side == 0 else (F.col("chunk") * mine, 1, F.col("chunk") * mine + (mine - 1))
        return held.withColumn("pair", F.explode(F.sequence(first, last, F.lit(step).cast("bigint")))).select(F.col("pair").cast("int"), "side", "heads", "means")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pairs.setdefault(row["pair"], ([], []))[row["side"]].append((row["heads"], row["means"]))
        for sides in pairs.values():
            if all(sides):
                (heads, means), (to, to_means) = (_sorted(side) for side in sides)
                inner, place = _best(heads, means, to, to_means)
                there = inner > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(heads[there]), pa.array(to[place[there]]), pa.array(inner[there])], ["head", "other", "inner"])

    both = chunks(clusters.filter("head = other"), mine, 0).unionByName(chunks(clusters, theirs, 1))
    found = both.repartitionById(mine * theirs, F.col("pair")).mapInArrow(compare, "head long, other long, inner double")
    best = found.groupBy("head").agg(F.max(F.struct("inner", F.bitwise_not("other").alias("other"))).alias("best"))
    return best.select("head", F.bitwise_not("best.other").alias("other"), F.greatest(1.0 - F.col("best.inner"), F.lit(0.0)).alias("height"))


def _sorted(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    heads = np.frombuffer(b"".join(p[0] for p in parts), np.int64)
    means, order = np.frombuffer(b"".join(p[1] for p in parts), np.float64).reshape(len(heads), -1), np.argsort(heads)
    return heads[order], means[order]


def _finish(clusters: list, number: int) -> list[tuple[int, int, float, int]]:
    """All merges of a few clusters, nearest first; of equally near ones the smallest heads."""
    clusters = sorted(clusters, key=lambda c: c["head"])
    heads = [c["head"] for c in clusters]
    totals, sizes = np.array([np.frombuffer(c["total"], np.float64) for c in clusters]), np.array([float(c["n"]) for c in clusters])
    means, merges = totals / sizes[:, None], []
    far = 1.0 - means @ means.T
    np.fill_diagonal(far, np.inf)
    for step in range(len(heads) - 1):
        i, j = sorted(divmod(int(far.argmin()), len(heads)))
        merges.append((heads[j], heads[i], float(max(far[i, j], 0.0)), number + step))
        totals[i], sizes[i] = totals[i] + totals[j], sizes[i] + sizes[j]
        means[i] = totals[i] / sizes[i]
        gone = np.isinf(far[i]) & (np.arange(len(heads)) != i)
        far[i] = 1.0 - means @ means[i]
        far[i, gone] = np.inf
        far[i, i] = np.inf
        far[j] = np.inf
        far[i, j] = np.inf
        far[:, i], far[:, j] = far[i], np.inf
    return merges


def _tasks(spark: SparkSession, count: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-count // PASS_ROWS))


def _merge_round(clusters: DataFrame, number: int, folder: str, asked: int, count: int) -> DataFrame:
    """The clusters after all reciprocal nearest ones are merged; ``asked`` of ``count`` clusters are compared. Merges are written."""
    spark = clusters.sparkSession
    near = clusters.filter("head <> other").select("head", "other", "height")
    if asked:
        near = near.unionByName(_nearest(clusters, asked, count))
    near.write.parquet(f"{folder}/near-{number}")
    near = spark.read.parquet(f"{folder}/near-{number}")
    back = near.select(F.col("head").alias("other"), F.col("other").alias("back"))
    pairs = near.join(back, "other").filter("head = back and head < other").select("head", "other", "height")
    if pairs.isEmpty():
        # Rounding made no pair reciprocal; the closest one is it by definition.
        pairs = near.select(F.least("head", "other").alias("head"), F.greatest("head", "other").alias("other"), "height").orderBy("height", "head", "other").limit(1)
    pairs.select(F.col("other").alias("child"), F.col("head").alias("parent"), "height", F.lit(number).alias("round")).write.parquet(f"{folder}/merges/{number}")
    merges = spark.read.schema(_MERGES).parquet(f"{folder}/merges/{number}")
    touched = merges.select(F.explode(F.array("child", "parent")).alias("other"), F.lit(True).alias("gone"))
    whole = merges.select(F.explode(F.array("child", "parent")).alias("head"), "parent")
    rows = clusters.select("head", "total", "n").join(near, "head").join(touched, "other", "left").join(whole, "head", "left")
    unknown = F.col("gone").isNotNull() | F.col("parent").isNotNull()
    rows = rows.withColumn("other", F.when(unknown, F.coalesce("parent", "head")).otherwise(F.col("other")))
    rows = rows.select(F.coalesce("parent", "head").alias("head"), "total", "n", "other", "height")
    tasks = _tasks(spark, count)
    rows.repartition(tasks, "head").groupBy("head").agg(F.collect_list("total").alias("total"), F.sum("n").alias("n"), F.max("other").alias("other"), F.max("height").alias("height")).mapInArrow(_added, _CLUSTERS).write.parquet(f"{folder}/clusters-{number}")
    return spark.read.schema(_CLUSTERS).parquet(f"{folder}/clusters-{number}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list of sums as their sum."""
    for batch in batches:
        sums = [x[0] if len(x) == 1 else np.sum([np.frombuffer(y, np.float64) for y in x], axis=0).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary()), *batch.columns[2:]], ["head", "total", "n", "other", "height"])


class _Few:
    """Rounds that compare few clusters. The table of clusters stays, what merges change is held beside it and goes along with each pass."""

    def __init__(self, clusters: DataFrame, count: int):
        self.clusters, self.count, self.spark = clusters, count, clusters.sparkSession
        self.dead: set[int] = set()
        #: Sums and rows of merged clusters, and the nearest (its height) of all that were compared.
        self.fresh: dict[int, tuple[np.ndarray, int]] = {}
        self.near: dict[int, tuple[int, float]] = {}
        self.merges: list[tuple[int, int, float, int]] = []
        self.tasks = _tasks(self.spark, count)

    def full(self) -> bool:
        return len(self.dead) + len(self.fresh) > FEW or len(self.near) > 8 * FEW

    def _beside(self) -> dict[str, np.ndarray]:
        """The changes as sorted arrays: clusters to pass over in the table, and clusters with another nearest one than it has."""
        near = np.array([(head, other) for head, (other, _) in self.near.items()], np.int64).reshape(-1, 2)
        near = near[np.argsort(near[:, 0])]
        return {"over": np.sort(np.array([*self.dead, *self.fresh], np.int64)), "head": near[:, 0], "other": near[:, 1]}

    def _pass(self, work, shared: dict, schema: str) -> list:
        """What ``work`` makes of each task's clusters of the table that still are as they were, and their nearest ones as they are now."""
        sent = self.spark.sparkContext.broadcast(shared | self._beside())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            kept = [batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), held["over"]))) for batch in batches]
            for batch in pa.Table.from_batches(kept).combine_chunks().to_batches() if kept else []:
                heads, others = batch.column(0).to_numpy(), batch.column(3).to_numpy().copy()
                at, moved = _found(held["head"], heads)
                others[moved] = held["other"][at]
                yield from work(held, batch, others)

        try:
            return self.clusters.select("head", "total", "n", "other").mapInArrow(run, schema).collect()
        finally:
            sent.destroy()

    def asked(self, touched: np.ndarray) -> dict[int, tuple[np.ndarray, int]] | None:
        """Sums and rows of the clusters whose nearest one is not known, or is among ``touched``; none if they may be too many."""
        most = -(-2 * FEW // self.tasks)

        def stale(held: dict, batch: pa.RecordBatch, others: np.ndarray) -> Iterator[pa.RecordBatch]:
            wanted = np.isin(others, held["touched"]) | (others == batch.column(0).to_numpy())
            if wanted.any():
                found = batch.filter(pa.array(wanted))
                packed = found.slice(0, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (packed.column(0).to_numpy().tobytes(), b"".join(packed.column(1).to_pylist()), packed.column(2).to_numpy().tobytes())] + [pa.array([found.num_rows], pa.int64())],
                    ["heads", "totals", "n", "found"],
                )

        rows = self._pass(stale, {"touched": touched}, "heads binary, totals binary, n binary, found long")
        gone = set(touched.tolist())
        out = {head: row for head, row in self.fresh.items() if head not in self.near or self.near[head][0] in gone}
        if sum(r["found"] for r in rows) + len(out) > FEW:
            return None
        for r in rows:
            heads, n = np.frombuffer(r["heads"], np.int64), np.frombuffer(r["n"], np.int64)
            if len(heads) < r["found"]:
                return None
            out |= zip(heads.tolist(), zip(np.frombuffer(r["totals"], np.float64).reshape(len(heads), -1), n.tolist()))
        return out

    def merge(self, rows: dict[int, tuple[np.ndarray, int]], number: int) -> np.ndarray:
        """Compares the clusters ``rows`` with all, merges reciprocal nearest ones and returns these."""
        heads = np.array(sorted(rows), np.int64)
        means = np.array([rows[h][0] / rows[h][1] for h in heads.tolist()])
        new = sorted(self.fresh)
        width = means.shape[1]
        shared = {
            "heads": heads, "means": means, "new": np.array(new, np.int64), "new_means": np.array([self.fresh[h][0] / self.fresh[h][1] for h in new]).reshape(-1, width),
        }

        def search(held: dict, batch: pa.RecordBatch, others: np.ndarray) -> Iterator[pa.RecordBatch]:
            to = batch.column(0).to_numpy()
            inner, place = _best(held["heads"], held["means"], to, _means(batch) if len(to) else np.zeros((0, width)))
            place = np.where(inner > -np.inf, place, -1)
            # What the driver needs to merge: the sums of clusters that are reciprocal as far as this task knows.
            back = np.array([len(to) > 0 and p >= 0 and others[p] == h for p, h in zip(place.tolist(), held["heads"].tolist())], bool)
            there = pa.array(place[back])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (
                    inner.tobytes(), np.where(place >= 0, np.append(to, 0)[place], 0).tobytes(), np.where(place >= 0, np.append(others, 0)[place], 0).tobytes(),
                    to[place[back]].tobytes(), b"".join(batch.column(1).take(there).to_pylist()), batch.column(2).take(there).to_numpy().tobytes(),
                )],
                ["inner", "to", "others", "heads", "totals", "n"],
            )

        names = ("inner", "to", "others", "heads", "totals", "n")
        found = self._pass(search, shared, ", ".join(f"{n} binary" for n in names))
        # Merged clusters are few, and met here.
        inner, place = _best(heads, means, shared["new"], shared["new_means"])
        to = np.append(shared["new"], 0)[np.where(inner > -np.inf, place, -1)]
        others = np.array([self.near.get(h, (h, 0.0))[0] for h in to.tolist()], np.int64)
        known = dict(rows)
        for row in found:
            i, t, o = np.frombuffer(row["inner"], np.float64), np.frombuffer(row["to"], np.int64), np.frombuffer(row["others"], np.int64)
            more = (i > inner) | ((i == inner) & (i > -np.inf) & (t < to))
            inner, to, others = np.where(more, i, inner), np.where(more, t, to), np.where(more, o, others)
            at, n = np.frombuffer(row["heads"], np.int64), np.frombuffer(row["n"], np.int64)
            known |= zip(at.tolist(), zip(np.frombuffer(row["totals"], np.float64).reshape(len(at), width), n.tolist()))
        known |= self.fresh
        height = np.maximum(1.0 - inner, 0.0)
        self.near |= zip(heads.tolist(), zip(to.tolist(), height.tolist()))
        touched = []
        for head, other, back, far in zip(heads.tolist(), to.tolist(), others.tolist(), height.tolist()):
            back = self.near[other][0] if other in self.near else back
            if back == head and (other not in rows or head < other):
                parent, child = min(head, other), max(head, other)
                (a, n), (b, m) = known[parent], known[child]
                touched.append((parent, child, a + b, n + m))
                self.merges.append((child, parent, far, number))
        for parent, child, total, n in touched:
            self.fresh[parent] = total, n
            self.fresh.pop(child, None)
            self.dead.add(child)
            for head in (parent, child):
                self.near.pop(head, None)
        self.count -= len(touched)
        return np.array([x for pair in touched for x in pair[:2]], np.int64)

    def written(self, folder: str, number: int, touched: np.ndarray) -> DataFrame:
        """The table with the changes in it; merges are written too. Clusters whose nearest one is among ``touched`` have an unknown one."""
        sent = self.spark.sparkContext.broadcast({
            "over": np.sort(np.array([*self.dead, *self.fresh], np.int64)), "touched": touched, "head": np.array(sorted(self.near), np.int64),
            "other": np.array([self.near[h][0] for h in sorted(self.near)], np.int64), "height": np.array([self.near[h][1] for h in sorted(self.near)]),
        })

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), held["over"])))
                heads, others, heights = batch.column(0).to_numpy(), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy(zero_copy_only=False).copy()
                at, moved = _found(held["head"], heads)
                others[moved], heights[moved] = held["other"][at], held["height"][at]
                others = np.where(np.isin(others, held["touched"]), heads, others)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(others), pa.array(heights)], ["head", "total", "n", "other", "height"])

        gone = set(touched.tolist())
        fresh = []
        for head, (total, n) in self.fresh.items():
            other, height = self.near.get(head, (head, 0.0))
            fresh.append((head, total.tobytes(), n, head if other in gone else other, height))
        rows = self.clusters.mapInArrow(run, _CLUSTERS).unionByName(self.spark.createDataFrame(fresh, _CLUSTERS))
        rows.repartition(_tasks(self.spark, self.count), "head").write.parquet(f"{folder}/few-{number}")
        self.spark.createDataFrame(self.merges, _MERGES).write.parquet(f"{folder}/merges/few-{number}")
        sent.destroy()
        return self.spark.read.schema(_CLUSTERS).parquet(f"{folder}/few-{number}")


def _few_rounds(clusters: DataFrame, count: int, last: int, number: int, folder: str) -> tuple[DataFrame, int]:
    """The clusters after as many rounds of few as there are one after the other, and the number of the next round."""
    few, touched = _Few(clusters, count), np.zeros(0, np.int64)
    while few.count > last:
        if few.full():
            few, touched = _Few(few.written(folder, number, touched), few.count), np.zeros(0, np.int64)
        rows = few.asked(touched)
        if not rows:
            break
        touched = few.merge(rows, number)
        number += 1
        if not len(touched):
            break
    return (few.written(folder, number, touched) if few.near or few.merges else few.clusters), number


def _roots(merges: DataFrame, folder: str) -> DataFrame:
    """(``child``, ``parent``) of all children, with the last of the parents one after the other; the way is halved each time."""
    links, number, more = merges.select("child", "parent"), 0, True
    while more:
        onward = links.select(F.col("child").alias("parent"), F.col("parent").alias("onward"))
        both = links.join(onward, "parent", "left")
        both.select("child", F.coalesce("onward", "parent").alias("parent"), F.col("onward").isNotNull().alias("moved")).write.parquet(f"{folder}/links-{number}")
        links = merges.sparkSession.read.parquet(f"{folder}/links-{number}")
        number, more = number + 1, not links.filter("moved").isEmpty()
    return links.select("child", "parent")


def average_linkage(df: DataFrame, vector: str, k: int, name: str = "cluster_label", last: int = LAST) -> DataFrame:
    """``df`` with the cluster of each row, from 0, when average linkage by cosine distance stops at ``k`` clusters.

    Numbers go by the smallest row of a cluster, in the order of the vectors' digests. Rows with equal directions are
    one from the start; vectors of zeros are at distance 1 from all others. Null vectors have no cluster. There are fewer
    clusters than ``k`` if there are fewer directions. Every round is written to the shared folder.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "linkage")
    vectors = df.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.col(vector).cast("array<double>")).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    found = vectors.groupBy("row").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.count("*").alias("n"))
    same = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(F.raise_error(F.lit("two vectors have one 64-bit digest")))
    found.select("row", same.alias("v"), "n").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    units = _units(rows.select("row", "v")).join(rows.select("row", "n"), "row")
    # The head of a cluster is its smallest digest.
    units.withColumn("head", F.min("row").over(Window.partitionBy("total"))).write.parquet(f"{folder}/heads")
    heads = spark.read.parquet(f"{folder}/heads")
    start = heads.groupBy("head").agg(F.any_value(F.when(F.col("row") == F.col("head"), F.col("total")), True).alias("one"), F.sum("n").alias("n"))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = _unpacked(batch.column(1), batch.num_rows) * batch.column(2).to_numpy()[:, None] if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(total), batch.column(2), batch.column(0), pa.array(np.zeros(batch.num_rows))], ["head", "total", "n", "other", "height"])

    start.mapInArrow(times, _CLUSTERS).write.parquet(f"{folder}/clusters")
    clusters, number = spark.read.schema(_CLUSTERS).parquet(f"{folder}/clusters"), 0

    def counts() -> tuple[int, int]:
        left, asked = clusters.agg(F.count(F.lit(1)), F.count(F.when(F.col("head") == F.col("other"), True))).first()
        return left, asked

    left, asked = counts()
    while left > last:
        if asked <= FEW:
            clusters, number = _few_rounds(clusters, left, last, number, folder)
            left, asked = counts()
        if left > last:
            clusters, number = _merge_round(clusters, number, folder, asked, left), number + 1
            left, asked = counts()
    # No more than ``last`` clusters.
    found = _finish(clusters.select("head", "total", "n").collect(), number) if left else []
    spark.createDataFrame(found, _MERGES).write.parquet(f"{folder}/merges/last")
    merges = spark.read.schema(_MERGES).parquet(f"{folder}/merges/*")
    # A cluster is never merged below the distance at which it was made: what is left out is the top of the tree.
    out = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("child")).limit(k - 1).select("child").collect()
    dropped = [row["child"] for row in out]
    roots = _roots(merges.filter(~F.col("child").isin(dropped)) if dropped else merges, folder)
    label = heads.select("row", "head").join(roots.withColumnRenamed("child", "head"), "head", "left").select("row", F.coalesce("parent", "head").alias("head"))
    label.write.parquet(f"{folder}/labels")
    label = spark.read.parquet(f"{folder}/labels")
    numbers = sorted(row["head"] for row in label.select("head").distinct().collect())
    number_of = F.array_position(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<bigint>"), F.col("head")).cast("int") - 1
    keyed = df.withColumn("__row", F.when(F.col(vector).isNotNull(), F.xxhash64(F.col(vector).cast("array<double>"))))
    return keyed.join(label.select(F.col("row").alias("__row"), number_of.alias(name)), "__row", "left").drop("__row")
