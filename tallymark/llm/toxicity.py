"""Toxicity by maximum-scoring segments.

Words are made of units: themselves and their runs of some bytes, hashed into a table of
fixed size. A unit's score is its log-odds of standing in a toxic text against a clean
one, under a Dirichlet prior that follows the whole corpus; of the log-odds only what
exceeds ``sure`` standard deviations counts, so rare units say nothing. A word scores as
its most telling unit, less a constant that makes the expected score negative.

A linear scan (each word is pushed and popped at most once) yields every maximal scoring
segment. By the theory of such scores, chance puts ``K n exp(-lambda S)`` segments of score S or
more into n clean words; lambda solves ``E[exp(lambda s)] = 1`` over clean words. What segments
exceed that, ``lambda S - ln(K n)``, is a text's evidence, and a logistic curve over the evidence of
the labelled texts makes it a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.counters import SCHEMA, add_up, pack
from tallymark.llm.tables import bound_batches, map_rows, slices
from tallymark.session import new_folder

#: Widths of the runs of bytes that are units beside the word itself; its two ends count as bytes.
RUNS = (5, 7, 9)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``most_labels`` bounds the labelled texts learned from (those of smallest hash); equal texts count once.

    ``table_bits`` sizes the table of units, ``prior`` is the weight of the corpus in the prior,
    ``floor`` is added to each unit's prior count, ``sure`` the standard deviations taken off,
    ``drift`` what each word costs, ``cut`` the score from which a text is called toxic.
    """

    most_labels: int = 200_000
    table_bits: int = 20
    prior: float = 0.02
    floor: float = 0.25
    sure: float = 0.7
    drift: float = 0.5
    cut: float = 0.7


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; bytes beyond ASCII count as letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def units_of(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the units of words, and which word each belongs to."""
    raw = np.frombuffer(b"\x01" + b"\x02\x01".join(words) + b"\x02", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) - starts[word]
    # A word whole: its bytes weighed by odd powers of a constant, wrapping around.
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat(raw * powers[place], starts)
    held, owner = [whole ^ np.uint64(0x5851F42D4C957F2D)], [np.arange(len(words))]
    for width in RUNS:
        at = np.flatnonzero(place + width <= sizes[word])
        run = np.full(len(at), width, np.uint64)
        for i in range(width):
            run = run * np.uint64(0xD1342543DE82EF95) + raw[at + i]
        held.append(run)
        owner.append(word[at])
    held = np.concatenate(held)
    held = (held ^ (held >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    held = (held ^ (held >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (held >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in order; in linear time.

    Neighbouring words of one sign act as one. Each candidate keeps the running sums before
    and after it; a new one swallows those left of it until one has a smaller sum before and
    the sum after isn't topped.
    """
    if not (scores > 0).any():
        return []
    sign = scores > 0
    edges = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]]).tolist()
    sums = np.add.reduceat(scores, starts).tolist()
    starts = starts.tolist()
    stack: list[list] = []
    total = 0.0
    for start, end, gain in zip(starts, ends, sums):
        if gain <= 0:
            total += gain
            continue
        candidate = [start, end, total, total + gain, -1]
        total += gain
        below = len(stack) - 1
        while True:
            # The nearest candidate with a smaller sum before it; links skip those already passed.
            while below >= 0 and stack[below][2] >= candidate[2]:
                below = stack[below][4]
            if below < 0 or stack[below][3] >= candidate[3]:
                candidate[4] = below
                stack.append(candidate)
                break
            candidate[0], candidate[2] = stack[below][0], stack[below][2]
            following = stack[below][4]
            del stack[below:]
            below = following
    return [(s, e, after - before) for s, e, before, after, _ in stack]


class WordScores(dict):
    """Scores of words met so far; filled for many words at once, emptied when full."""

    most = 500_000

    def __init__(self, table: np.ndarray, settings: Settings):
        self.table, self.settings = table, settings

    def fill(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self]
        if not fresh:
            return
        if len(self) + len(fresh) > self.most:
            self.clear()
            fresh = list(words)
        place, word = units_of(fresh, self.settings.table_bits)
        held = self.table[place]
        high, low = np.zeros(len(fresh), np.float32), np.zeros(len(fresh), np.float32)
        np.maximum.at(high, word, held)
        np.minimum.at(low, word, held)
        scores = np.where(high > 0, high, np.maximum(low, -1)) - self.settings.drift
        self.update(zip(fresh, scores.tolist()))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def held_out(id_column: str | Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """The unit table, the calibration of segments (``rate`` is lambda, ``scale`` is K) and of texts."""

    settings: Settings
    table: np.ndarray
    rate: float
    scale: float
    slope: float
    offset: float

    def evidence(self, n_words: int, segments: list[float]) -> float:
        if not segments:
            return 0.0
        chance = math.log(max(self.scale * n_words, 1.0))
        return sum(max(0.0, self.rate * s - chance) for s in segments)

    def probability(self, evidence: float) -> float:
        z = self.slope * math.log1p(evidence) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _learners(docs: DataFrame, labels: DataFrame, settings: Settings, id_column: str, text_column: str, label_column: str) -> dict[int, bool]:
    """Ids to learn from with their labels: at most ``most_labels``, one for each text, none held out."""
    usable = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    usable = usable.groupBy(F.col(id_column).cast("long").alias("learn_id")).agg(F.max(label_column).alias("learn_toxic"))
    sample = usable.orderBy(F.xxhash64("learn_id"), "learn_id").limit(settings.most_labels)
    # Bounded by most_labels: 20 bytes each.
    texts = docs.select(F.col(id_column).cast("long").alias("learn_id"), F.col(text_column).alias("learn_text")).join(F.broadcast(sample), "learn_id")
    texts = texts.select("learn_id", "learn_toxic", F.xxhash64(F.coalesce("learn_text", F.lit(""))).alias("digest"))
    once = texts.groupBy("digest").agg(F.max(F.struct("learn_toxic", -F.col("learn_id"))).alias("kept"))
    rows = once.select("kept.*").toDF("toxic", "id").toPandas()
    return {-int(i): bool(t) for i, t in zip(rows["id"], rows["toxic"])}


def _count_units(docs: DataFrame, learners: dict[int, bool], settings: Settings, id_column: str, text_column: str) -> np.ndarray:
    """Rows: units of the words of all texts; toxic texts with a unit; clean texts with it."""
    size = 1 << settings.table_bits
    known = docs.sparkSession.sparkContext.broadcast(learners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((3, size), np.int64)
        corpus: Counter = Counter()

        def empty() -> None:
            if corpus:
                place, word = units_of(list(corpus), settings.table_bits)
                times = np.fromiter(corpus.values(), np.int64, len(corpus))
                counters[0] += np.bincount(place, weights=times[word], minlength=size).astype(np.int64)
                corpus.clear()

        for batch in batches:
            for piece in slices(batch, 1):
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    words = words_of(text)
                    corpus.update(words)
                    if words and (toxic := known.value.get(key)) is not None:
                        counters[1 if toxic else 2][np.unique(units_of(list(set(words)), settings.table_bits)[0])] += 1
                if len(corpus) > 400_000:
                    empty()
        empty()
        yield pack(counters.reshape(-1))

    bound_batches(docs.sparkSession)
    packed = docs.select(F.col(id_column).cast("long"), text_column).mapInArrow(run, SCHEMA)
    return add_up(packed, 3 * size).reshape(3, size)


def _log_odds(counts: np.ndarray, learners: dict[int, bool], settings: Settings) -> np.ndarray:
    """What a unit's log-odds exceed ``sure`` standard deviations by, with its sign."""
    corpus, toxic, clean = counts.astype(np.float64)
    n_toxic = sum(learners.values())
    n_clean = len(learners) - n_toxic
    if not n_toxic or not n_clean:
        return np.zeros(counts.shape[1], np.float32)
    # Texts of the sample in which a unit would stand if it were spread as in the corpus.
    share = corpus / max(corpus.sum(), 1)
    present = (toxic + clean).sum()
    prior = settings.floor + settings.prior * present * share
    odds = np.log(toxic + prior) - np.log(np.maximum(n_toxic - toxic, 0) + 1 + prior)
    odds -= np.log(clean + prior) - np.log(np.maximum(n_clean - clean, 0) + 1 + prior)
    # With equal counts nothing is known: the prior alone must give 0.
    odds -= np.log(prior / (n_toxic + 1 + prior)) - np.log(prior / (n_clean + 1 + prior))
    spread = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - settings.sure * spread)
    return np.where(toxic + clean > 0, sure, 0).astype(np.float32)


def _solve_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda s)] = 1; large if no clean word scores above 0."""
    share = counts / max(counts.sum(), 1)
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum())
    low, high = 1e-6, 5.0
    if not len(scores) or value(high) < 1:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return low


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps with a small ridge."""
    if not len(y):
        return 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], 1)
    weights = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ weights
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, gradient)
        weights = weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0]), float(weights[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from the labelled texts that aren't held out, and from the words of all texts."""
    settings = settings or Settings()
    spark = docs.sparkSession
    learners = _learners(docs, labels, settings, id_column, text_column, label_column)
    counts = _count_units(docs, learners, settings, id_column, text_column)
    table = _log_odds(counts, learners, settings)
    known, weights = spark.sparkContext.broadcast(learners), spark.sparkContext.broadcast(table)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights.value, settings)
        hit = pa.array([key in known.value for key in batch.column(0).to_pylist()])
        for piece in slices(batch.filter(hit), 1):
            rows = []
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                words = words_of(text)
                scores.fill(set(words))
                held = scores.of(words)
                rounded, times = np.unique(np.round(held, 1), return_counts=True)
                rows.append((key, known.value[key], len(words), [s for _, _, s in maximal_segments(held)], rounded.tolist(), times.tolist()))
            ids, toxic, sizes, segments, rounded, times = map(list, zip(*rows)) if rows else ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(toxic, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(segments, pa.list_(pa.float64())), pa.array(rounded, pa.list_(pa.float64())), pa.array(times, pa.list_(pa.int64()))],
                ["id", "toxic", "n", "segments", "scores", "times"],
            )

    schema = "id long, toxic boolean, n long, segments array<double>, scores array<double>, times array<long>"
    measured = map_rows(docs, [F.col(id_column).cast("long"), text_column], measure, schema)
    folder = new_folder(spark, "toxicity")
    measured.write.parquet(folder)
    measured = spark.read.schema(schema).parquet(folder)
    # Bounded by most_labels rows.
    rows = measured.select("toxic", "n", "segments").toPandas()
    rows["toxic"] = rows["toxic"].astype(bool)
    clean = rows[~rows["toxic"]]
    spread = (
        measured.filter("not toxic").select(F.explode(F.arrays_zip("scores", "times")).alias("x")).groupBy("x.scores").agg(F.sum("x.times").alias("times")).toPandas()
    )
    rate = _solve_rate(spread["scores"].to_numpy(float), spread["times"].to_numpy(float))
    n_words = max(int(clean["n"].sum()), 1)
    found = np.concatenate([np.empty(0), *(np.asarray(s, float) for s in clean["segments"])])
    # K from the upper half of the clean segments; one segment at least.
    least = float(np.median(found)) if len(found) else 0.0
    scale = max(int((found >= least).sum()), 1) / n_words * math.exp(min(rate * least, 50))
    model = Model(settings, table, rate, min(scale, 1.0), 0.0, 0.0)
    x = np.array([math.log1p(model.evidence(n, list(s))) for n, s in zip(rows["n"], rows["segments"])])
    slope, offset = _fit_curve(x, rows["toxic"].to_numpy(float))
    return Model(settings, table, rate, min(scale, 1.0), slope, offset)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted`` and the passages found.

    ``n_segments`` counts the segments beyond chance and ``top_start``, ``top_end`` give the words of the best
    (null if none). A null or empty text has no words and scores what a text without evidence
    does. Null ids stay null and aren't held out, repeated rows score alike, further columns are left out.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.table)
    slim = Model(model.settings, np.empty(0), model.rate, model.scale, model.slope, model.offset)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights.value, slim.settings)
        for piece in slices(batch, 1):
            results, numbers, starts, ends = [], [], [], []
            for text in piece.column(1).to_pylist():
                words = words_of(text)
                scores.fill(set(words))
                segments = maximal_segments(scores.of(words))
                chance = math.log(max(slim.scale * len(words), 1.0))
                beyond = [s for s in segments if slim.rate * s[2] > chance]
                best = max(beyond, key=lambda s: s[2], default=None)
                results.append(slim.probability(slim.evidence(len(words), [s[2] for s in segments])))
                numbers.append(len(beyond))
                starts.append(best and best[0])
                ends.append(best and best[1])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), piece.column(2), pa.array(results, pa.float64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["doc_id", "held_out", "score", "n_segments", "top_start", "top_end"],
            )

    schema = "doc_id long, held_out boolean, score double, n_segments long, top_start long, top_end long"
    found = map_rows(docs, [F.col(id_column), F.col(text_column), held_out(id_column)], run, schema)
    return found.withColumn("predicted", (F.col("score") >= model.settings.cut).cast("int"))
