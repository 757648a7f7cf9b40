"""Leading eigenvectors of a graph's normalised adjacency, by a block of vectors multiplied in pieces.

Nodes are dealt out in blocks of bounded size. A block's piece of the vectors and the edges that leave it meet in one task, which sends each
other block its sums; a second task adds up what a block receives. The vectors and their images span a space in which the best vectors
are found from inner products alone; these are sums of a size that the graph does not change. The best ones start the next round, until what a
multiplication leaves beside them is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.learning.shared import Totals, totals
from tallymark.session import new_folder, shuffles_dropped

#: Vectors beyond those asked for, and multiplications in a round.
SPARE, IMAGES = 5, 12
#: Nodes of a block on average, and nodes whose sums are made at a time.
BLOCK_ROWS, PIECE_ROWS = 16384, 4096
#: Bytes of the images of a round as a rule, of those that are shuffled at a time, and of vectors that are sent to all tasks.
IMAGE_BYTES, SHUFFLED_BYTES, SENT_BYTES = 512 * 1024 * 1024, 256 * 1024 * 1024, 128 * 1024 * 1024
#: Images of a round at least, if the graph has so many nodes that more take too much disk.
FEWEST_IMAGES = 4

_IMAGE = "block int, image int, x binary"


def _by_block(batches: Iterator[pa.RecordBatch]) -> dict[int, list[pa.RecordBatch]]:
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            held.setdefault(block, []).append(batch.filter(pa.array(blocks == block)))
    return held


def _numbers(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([part.column(part.schema.get_field_index(name)).to_numpy() for part in parts])


def _pieces(parts: list[pa.RecordBatch], width: int) -> dict[int, np.ndarray]:
    """The pieces of a block by the number of their image."""
    rows = [row for part in parts for row in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
    return {image: np.frombuffer(x, np.float64).reshape(-1, width) for image, x in rows}


def _packed_edges(edges: DataFrame, blocks: int, before: np.ndarray | None) -> DataFrame:
    """A row for each block: the edges (``to``, ``start``, ``share``) that leave it, in the order of their ends.

    If the nodes ``before`` each block are given, ends are counted over all blocks and the order is that of the starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches).items():
            to, start, share = (_numbers(parts, name) for name in ("to", "start", "share"))
            if before is None:
                order = np.argsort(to, kind="stable")
            else:
                to = before[to >> 32] + (to & 0xFFFFFFFF)
                order = np.lexsort((to, start))
            packed = [to[order].tobytes(), start[order].astype(np.int32).tobytes(), share[order].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["block", "to", "start", "share"])

    return edges.select("block", "to", "start", "share").repartitionById(blocks, F.col("block")).mapInArrow(run, "block int, to binary, start binary, share binary")


def _packed_start(rows: DataFrame, blocks: int) -> DataFrame:
    """A row for each block: its nodes' vectors ``v`` in the order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches).items():
            order = np.argsort(_numbers(parts, "place"))
            v = np.concatenate([part.column(2).flatten().to_numpy(zero_copy_only=False) for part in parts]).reshape(len(order), -1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([v[order].tobytes()], pa.binary())], ["block", "image", "x"])

    return rows.select("block", "place", "v").repartitionById(blocks, F.col("block")).mapInArrow(run, _IMAGE)


def _multiplied(edges: DataFrame, x: DataFrame, width: int, image: int, blocks: int) -> DataFrame:
    """The normalised adjacency times the vectors ``x``."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["block"], {}).update({name: value for name, value in row.items() if value is not None})
        for row in held.values():
            x = np.frombuffer(row["x"], np.float64).reshape(-1, width)
            to, start, share = np.frombuffer(row["to"], np.int64), np.frombuffer(row["start"], np.int32), np.frombuffer(row["share"], np.float64)
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            ends, sums = to[first], np.empty((len(first), width))
            for i in range(0, len(first), PIECE_ROWS):
                mine = first[i : i + PIECE_ROWS]
                some = slice(mine[0], first[i + PIECE_ROWS] if i + PIECE_ROWS < len(first) else len(to))
                sums[i : i + PIECE_ROWS] = np.add.reduceat(x[start[some]] * share[some, None], mine - mine[0])
            cuts = np.flatnonzero(np.append(True, (ends[1:] >> 32) != (ends[:-1] >> 32)))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ends)]):
                places = (ends[a:b] & 0xFFFFFFFF).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([int(ends[a] >> 32)], pa.int32()), pa.array([places.tobytes()], pa.binary()), pa.array([sums[a:b].tobytes()], pa.binary())], ["block", "places", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["block"], []).append((np.frombuffer(row["places"], np.int32), np.frombuffer(row["sums"], np.float64).reshape(-1, width)))
        for block, parts in held.items():
            # Every node has an edge. Parts are added in one order, so that a repeated task has the same sums.
            out = np.zeros((1 + max(int(places.max()) for places, _ in parts), width))
            for places, sums in sorted(parts, key=lambda part: part[1].tobytes()):
                out[places] += sums
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([image], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "image", "x"])

    both = edges.withColumn("x", F.lit(None).cast("binary")).unionByName(x.select("block", "x"), allowMissingColumns=True)
    sums = both.repartitionById(blocks, F.col("block")).mapInArrow(multiply, "block int, places binary, sums binary")
    return sums.repartitionById(blocks, F.col("block")).mapInArrow(add, _IMAGE)


def _multiplied_by_sent(edges: DataFrame, sent: Broadcast, image: int) -> DataFrame:
    """As :func:`_multiplied`, of vectors that all tasks have whole: nothing is shuffled."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                to, start, share = np.frombuffer(row["to"], np.int64), np.frombuffer(row["start"], np.int32), np.frombuffer(row["share"], np.float64)
                # Every node has an edge.
                first = np.append(np.flatnonzero(np.append(True, start[1:] != start[:-1])), len(start))
                out = np.empty((len(first) - 1, x.shape[1]))
                for i in range(0, len(out), PIECE_ROWS):
                    mine = first[i : i + PIECE_ROWS + 1]
                    some = slice(mine[0], mine[-1])
                    out[i : i + PIECE_ROWS] = np.add.reduceat(x[to[some]] * share[some, None], mine[:-1] - mine[0])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([image], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "image", "x"])

    return edges.mapInArrow(multiply, _IMAGE)


def _send(x: DataFrame, width: int) -> Broadcast:
    table = x.select("block", "x").toArrow().sort_by("block")
    return x.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(-1, width))


def _products(rows: DataFrame, width: int, blocks: int) -> np.ndarray:
    """Inner products of all columns of all images."""

    def work(batches: Iterator[pa.RecordBatch]) -> Totals:
        total = 0.0
        for parts in _by_block(batches).values():
            pieces = _pieces(parts, width)
            b = np.concatenate([pieces[image] for image in sorted(pieces)], axis=1)
            total = total + b.T @ b
        return {"products": total} if np.ndim(total) else {}

    return totals(rows.repartitionById(blocks, F.pmod("block", F.lit(blocks))), work, blocks).get("products", 0.0)


def _turned(rows: DataFrame, turn: np.ndarray, width: int, blocks: int) -> DataFrame:
    """The columns of the images combined by a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches).items():
            out = sum(x @ turn[image * width : (image + 1) * width] for image, x in sorted(_pieces(parts, width).items(), key=lambda piece: piece[0]))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "image", "x"])

    return rows.repartitionById(blocks, F.pmod("block", F.lit(blocks))).mapInArrow(run, _IMAGE)


def _unpacked(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(``block``, ``place``, ``v``): the first ``k`` of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                v = np.frombuffer(x, np.float64).reshape(-1, width)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(list(v), pa.list_(pa.float64()))], ["block", "place", "v"])

    return rows.mapInArrow(run, "block int, place int, v array<double>")


def eigenvectors(edges: DataFrame, k: int, *, seed: int = 0, tolerance: float = 1e-3, rounds: int = 60) -> tuple[DataFrame, np.ndarray]:
    """The ``k`` leading eigenvectors (``node``, ``degree``, ``v``) and eigenvalues, largest first.

    ``edges`` (``a``, ``b``, ``weight`` above 0) holds each pair of nodes once; repeated pairs add up, loops count. Of a graph with fewer
    than ``k`` nodes there are as many vectors. The images of a round are written to the shared folder, over those of the round before; what a
    multiplication has shuffled goes when its image is written.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "spectral")
    with shuffles_dropped(spark):
        flipped = edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
        edges.select("a", "b", "weight").unionByName(flipped).groupBy("a", "b").agg(F.sum("weight").alias("weight")).write.parquet(f"{folder}/edges")
        edges = spark.read.parquet(f"{folder}/edges")
        nodes = edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
        count = nodes.count()
        k, width, blocks = min(k, count), min(k + SPARE, count), -(-count // BLOCK_ROWS) or 1
        block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
        place = F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1
        nodes.withColumn("block", block).withColumn("place", place).write.parquet(f"{folder}/nodes")
        nodes = spark.read.parquet(f"{folder}/nodes")
        draw = [(F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0) for i in range(width)]
        # The first vector is the known one, so that its value is exact from the start.
        start = [F.sqrt("degree"), *draw[1:]]
        _packed_start(nodes.withColumn("v", F.array(*start)), blocks).write.parquet(f"{folder}/start-0")
        at = nodes.select(F.col("node").alias("a"), F.shiftleft(F.col("block").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("to"), F.col("degree").alias("degree_a"))
        left = nodes.select(F.col("node").alias("b"), "block", F.col("place").alias("start"), F.col("degree").alias("degree_b"))
        share = F.col("weight") / (F.sqrt("degree_a") * F.sqrt("degree_b"))
        sizes = {row["block"]: row["count"] for row in nodes.groupBy("block").count().collect()}
        whole = count * width * 8
        before = np.append(0, np.cumsum([sizes.get(at, 0) for at in range(blocks)])) if whole <= SENT_BYTES else None
        _packed_edges(edges.join(at, "a").join(left, "b").withColumn("share", share), blocks, before).write.parquet(f"{folder}/packed")
        # Their place is needed for images.
        spark.createDataFrame([], edges.schema).write.mode("overwrite").parquet(f"{folder}/edges")
        packed = spark.read.parquet(f"{folder}/packed")

        def images(*paths: str) -> DataFrame:
            return spark.read.schema(_IMAGE).parquet(*(f"{folder}/{path}" for path in paths))

        def multiplied(x: DataFrame, image: int, path: str) -> None:
            if before is None:
                return _multiplied(packed, x, width, image, blocks).write.mode("overwrite").parquet(path)
            sent = _send(x, width)
            _multiplied_by_sent(packed, sent, image).write.mode("overwrite").parquet(path)
            sent.destroy(blocking=True)

        values, most = np.zeros(width), min(IMAGES, max(FEWEST_IMAGES, IMAGE_BYTES // whole)) if whole else IMAGES
        step = -(-blocks // max(1, -(-whole * (most + 1) // SHUFFLED_BYTES)))
        # Blocks whose images are shuffled at a time.
        groups = [list(range(first, min(first + step, blocks))) for first in range(0, blocks, step)]
        for number in range(-(-rounds * IMAGES // most)):
            # The vectors of this round are read while those of the next one are written.
            paths = [f"start-{number % 2}", *(f"image-{image}" for image in range(1, most + 1))]
            for image in range(1, most + 1):
                multiplied(images(paths[image - 1]), image, f"{folder}/{paths[image]}")
            products = sum(_products(images(*paths).filter(F.col("block").isin(group)), width, len(group)) for group in groups)
            size = most * width
            inner, moved = products[:size, :size], products[:size, width:]
            spread, turn = np.linalg.eigh(inner)
            kept = spread > 1e-13 * spread[-1]
            basis = turn[:, kept] / np.sqrt(spread[kept])
            found, best = np.linalg.eigh(basis.T @ ((moved + moved.T) / 2) @ basis)
            values, turn = found[::-1][:width], basis @ best[:, ::-1][:, :width]
            # What one more multiplication leaves beside the vectors: |S v - value v|.
            both = np.zeros((size + width, turn.shape[1]))
            both[width:] += turn
            both[:size] -= turn * values
            beside = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", both, products, both), 0.0))
            for i, group in enumerate(groups):
                rows = _turned(images(*paths[:-1]).filter(F.col("block").isin(group)), turn, width, len(group))
                rows.write.mode("append" if i else "overwrite").parquet(f"{folder}/start-{(number + 1) % 2}")
            rows, width = images(f"start-{(number + 1) % 2}"), turn.shape[1]
            if beside[:k].max(initial=0.0) <= tolerance:
                break
    return nodes.join(_unpacked(rows, width, min(k, width)), ["block", "place"]).select("node", "degree", "v"), values[:k]
