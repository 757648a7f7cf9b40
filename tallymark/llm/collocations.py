"""Phrases whose words occur together far more often than apart, by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Single words are counted from the first shard on. A longer
phrase becomes active once both phrases that it overlaps from, all but its last and all but its first word,
have been seen ``least`` times in the shards so far; it is counted from the next shard on, until the cycle has come
round to where it began. So lengths are counted side by side, and every active phrase gets the whole corpus exactly
once. A phrase is seen no more often than its parts, so none that occurs ``least`` times is missed.

Which phrases are active stands in a table of one byte for each slot of their hashes: the scan from which the slot
counts. Its size follows from the number of words up to a bound. Slots that phrases share start some phrases
for nothing, which costs rows and changes no count; counts themselves are kept by the words of a phrase. Tasks
count their own phrases before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.shingle_join import mix
from tallymark.llm.tables import DROP_SHUFFLES, bound_batches, setting, slices
from tallymark.session import new_folder

_ONE = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to lower case, tabs to blanks, all ends of a piece to line ends.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(_ENDS))
#: Bits of the smallest and the largest table of slots, a byte each.
LEAST_BITS, MOST_BITS = 16, 25
#: A slot that no scan counts yet.
IDLE = 255
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 22
#: Words that a task counts at a time.
HELD_WORDS = 1 << 21
#: Parts in which the best of a language are ranked first, so that no task ranks a whole one.
RANK_PARTS = 64


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to ``longest`` words seen ``least`` times; ``shards`` parts of the corpus."""

    longest: int = 3
    least: int = 10
    shards: int = 2
    inside: int = 50
    best: int = 2000


def stretches(text: bytes) -> Iterator[bytes]:
    """A folded text in stretches of whole pieces, of about ``STRETCH`` bytes if pieces are shorter."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b"\n", start + STRETCH)
        end = len(folded) if end < 0 else end + 1
        yield folded[start:end]
        start = end


def words_of(folded: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a folded text, and for each the number of the piece it stands in."""
    held = folded.split()
    if not held:
        return held, np.empty(0, np.int64)
    letters = np.frombuffer(folded, np.uint8)
    apart = (letters == 32) | (letters == 10)
    starts = np.flatnonzero(~apart[1:] & apart[:-1]) + 1
    if not apart[0]:
        starts = np.concatenate([[0], starts])
    return held, np.cumsum(letters == 10)[starts]


def word_hashes(held: list[bytes], lang: bytes) -> np.ndarray:
    """A hash for each word; the language is part of it."""
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, held, repeat(seed)), np.uint64, len(held))


def _counted(columns: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of some columns, their first scans and numbers."""
    rest = columns[1]
    for column in columns[2:]:
        rest = mix(rest * _ONE + column)
    # By the first word, so that rows of one stand together and pack well; equal rows are neighbours, nearly always.
    low = np.uint64(32)
    order = np.argsort((columns[0] >> low << low) | (mix(rest) >> low))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], starts[order][at], np.diff(np.append(at, len(order)))


class Scan:
    """The phrases active in one scan, counted over texts of a task."""

    def __init__(self, step: int, how: Phrases, active: list[np.ndarray]):
        # active: for each length but the last, the scan from which phrases that hold its phrase count, by slot.
        self.step, self.how, self.active = step, how, active
        self.bits = len(active[0]).bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.singles: dict[bytes, Counter] = {}
        self.longer: list[list[tuple[list[np.ndarray], np.ndarray]]] = [[] for _ in range(self.how.longest - 1)]
        self.words = 0

    def _slots(self, folded: np.ndarray) -> np.ndarray:
        return (mix(folded) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, text: bytes, lang: bytes) -> None:
        for stretch in stretches(text):
            self._add(stretch, lang)

    def _add(self, stretch: bytes, lang: bytes) -> None:
        held, pieces = words_of(stretch)
        if not held:
            return
        self.words += len(held)
        if self.step < self.how.shards:
            self.singles.setdefault(lang, Counter()).update(held)
        if self.step == 0 or len(held) < 2:
            return
        words = word_hashes(held, lang)
        # Of phrases of one length: their first words' places, the scan they start at, and their hash.
        at, folded = np.arange(len(words)), words
        for length in range(2, self.how.longest + 1):
            ready = self.active[length - 2][self._slots(folded)]
            # Two phrases one word apart, in one piece, make a longer one.
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            follows = follows[pieces[at[follows]] == pieces[at[follows] + length - 1]]
            start = np.maximum(ready[follows], ready[follows + 1])
            begun = start != IDLE
            follows, start = follows[begun], start[begun]
            counts = self.step < start.astype(np.int64) + self.how.shards
            if counts.any():
                first = at[follows[counts]]
                self.longer[length - 2].append(([words[first + i] for i in range(length)], start[counts]))
            folded = mix(folded[follows] * _ONE + words[at[follows] + length - 1])
            at = at[follows]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call."""
        longest = self.how.longest
        for lang, counts in self.singles.items():
            held = list(counts)
            n = len(held)
            words = [pa.array(word_hashes(held, lang).view(np.int64)), *[pa.nulls(n, pa.int64())] * (longest - 1)]
            yield self._batch(words, np.zeros(n, np.int64), np.fromiter(counts.values(), np.int64, n), pa.array(held, pa.binary()).cast(pa.string()), lang)
            # All words of the language, as the phrase of no word.
            yield self._batch([pa.nulls(1, pa.int64())] * longest, np.zeros(1, np.int64), np.array([counts.total()]), pa.nulls(1, pa.string()), lang)
        for found in self.longer:
            if found:
                columns = [np.concatenate([c[i] for c, _ in found]) for i in range(len(found[0][0]))]
                columns, starts, counts = _counted(columns, np.concatenate([s for _, s in found]))
                words = [pa.array(c.view(np.int64)) for c in columns] + [pa.nulls(len(counts), pa.int64())] * (longest - len(columns))
                yield self._batch(words, starts, counts, pa.nulls(len(counts), pa.string()), None)
        self.clear()

    def _batch(self, words: list[pa.Array], starts: np.ndarray, counts: np.ndarray, texts: pa.Array, lang: bytes | None) -> pa.RecordBatch:
        n = len(counts)
        langs = pa.nulls(n, pa.string()) if lang is None else pa.array([lang.decode()] * n, pa.string())
        return pa.RecordBatch.from_arrays([*words, pa.array(starts.astype(np.int32)), texts, langs, pa.array(counts.astype(np.int64))], _names(self.how))


def _names(how: Phrases) -> list[str]:
    return [*(f"w{i}" for i in range(1, how.longest + 1)), "start", "word", "lang", "n"]


def _schema(how: Phrases) -> str:
    return ", ".join([*(f"w{i} long" for i in range(1, how.longest + 1)), "start int, word string, lang string, n long"])


def _of_length(rows: DataFrame, length: int, how: Phrases) -> DataFrame:
    """The rows of phrases of one length; 0 are the languages' words."""
    if length < how.longest:
        rows = rows.filter(F.col(f"w{length + 1}").isNull())
    return rows.filter(F.col(f"w{length}").isNotNull()) if length else rows


def _scan(docs: DataFrame, step: int, how: Phrases, shared: Broadcast) -> DataFrame:
    """Counts of the phrases active in a scan, of its shard, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(step, how, shared.value)
        for batch in batches:
            for piece in slices(batch, 0):
                for text, lang in zip(piece.column(0).cast(pa.binary()).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist()):
                    scan.add(text or b"", lang)
                    if scan.words >= HELD_WORDS:
                        yield from scan.rows()
        yield from scan.rows()

    shard = F.pmod(F.xxhash64("id"), F.lit(how.shards)) == step % how.shards
    return docs.filter(shard).select("text", "lang").mapInArrow(run, _schema(how))


def _activate(active: list[np.ndarray], rows: DataFrame, step: int, how: Phrases) -> bool:
    """Let phrases that hold one seen often enough count from scan ``step`` on, by their slots; whether there are new ones."""
    bits = len(active[0]).bit_length() - 1
    words = [f"w{i}" for i in range(1, how.longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(words))]
            for length in range(1, len(words) + 1):
                own = columns[length - 1].is_valid()
                if length < len(words):
                    own = pc.and_(own, columns[length].is_null())
                held = [c.filter(own).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in columns[:length]]
                folded = held[0]
                for column in held[1:]:
                    folded = mix(folded * _ONE + column)
                slots = np.unique((mix(folded) >> np.uint64(64 - bits)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), length, np.int32)), pa.array(slots)], ["length", "slot"])

    # Phrases of the greatest length make no longer ones. Their words are null where w1 is, too.
    often = rows.filter((F.col("n") >= how.least) & F.col("w1").isNotNull() & F.col(f"w{how.longest}").isNull()).select(*words)
    # At most 2 ** (MOST_BITS - 6) rows of 20 bytes for each length.
    found = (
        often.mapInArrow(run, "length int, slot long")
        .groupBy("length", F.shiftright("slot", 6).alias("place"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("held"))
        .toPandas()
    )
    new = False
    for length, own in found.groupby("length"):
        marks = np.zeros(max(1, len(active[0]) >> 6), np.int64)
        marks[own["place"].to_numpy(np.int64)] = own["held"].to_numpy(np.int64)
        hit = np.unpackbits(marks.view(np.uint8), bitorder="little").astype(bool)[: len(active[0])]
        hit &= active[length - 1] == IDLE
        active[length - 1][hit] = step
        new |= bool(hit.any())
    return new


def frequent(df: DataFrame, how: Phrases, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """Every phrase of up to ``longest`` words seen ``least`` times, and the words of each language, counted exactly.

    Columns ``w1`` and on (hashes of the words, null beyond its length), ``word`` and ``lang`` (of single words; ``lang`` also
    of the row without words) and ``n``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    if how.longest * how.shards >= IDLE:
        raise ValueError("too many scans")
    docs = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    folder = new_folder(spark, "phrases")
    schema = _schema(how)
    keys = [c for c in _names(how) if c != "n"]
    active = [np.full(1 << LEAST_BITS, IDLE, np.uint8) for _ in range(how.longest - 1)]
    # The last scan is the one before the youngest phrases' cycle has come round.
    done, open_rows, step, last = [], None, 0, how.shards
    while step < last:
        shared = spark.sparkContext.broadcast(active)
        rows = _scan(docs, step, how, shared)
        if open_rows is not None:
            rows = rows.unionByName(open_rows)
        over = F.col("start") + how.shards - 1 <= step
        # Whole counts that are too small go; words stay until their hashes are checked.
        kept = ~over | (F.col("n") >= how.least) | F.col("word").isNotNull() | F.col("w1").isNull()
        # The scans' shuffles would add up.
        with setting(spark, DROP_SHUFFLES, "true"):
            rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter(kept).write.parquet(f"{folder}/{step}")
        shared.destroy()
        rows = spark.read.schema(schema).parquet(f"{folder}/{step}")
        if step == 0:
            # A byte for 32 words of the corpus, nearly.
            seen = rows.filter("w1 is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * how.shards
            bits = min(max((seen // 32).bit_length(), LEAST_BITS), MOST_BITS)
            active = [np.full(1 << bits, IDLE, np.uint8) for _ in active]
        if step == how.shards - 1:
            same = rows.filter("word is not null").groupBy("w1").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
            if not same.filter((F.col("words") > 1) & (F.col("n") >= how.least)).isEmpty():
                raise ValueError("two words have one 64-bit digest")
        open_rows = rows.filter(~over)
        done.append(rows.filter(over & ((F.col("n") >= how.least) | F.col("w1").isNull())))
        step += 1
        if _activate(active, rows, step, how):
            last = step + how.shards
    found = done[0]
    for rows in done[1:]:
        found = found.unionByName(rows)
    # Read many times, and far smaller than the scans' counts.
    found.drop("start").write.parquet(f"{folder}/found")
    return spark.read.schema(", ".join(c for c in schema.split(", ") if not c.startswith("start"))).parquet(f"{folder}/found")


def _scored(found: DataFrame, length: int, how: Phrases) -> DataFrame:
    """Phrases of one length with language, text, counts and the score of their lowest-scoring cut."""
    words = _of_length(found, 1, how).select("w1", "word", "lang", "n")
    rows = _of_length(found, length, how).select(*(f"w{i}" for i in range(1, length + 1)), F.col("n").alias("a"))
    counts: dict[tuple[int, int], str] = {}
    for i in range(1, length + 1):
        one = [F.col("w1").alias(f"w{i}"), F.col("word").alias(f"word{i}")]
        if i in (1, length):
            counts[i, i] = f"n{i}_{i}"
            one.append(F.col("n").alias(f"n{i}_{i}"))
        if i == 1:
            one.append(F.col("lang"))
        rows = rows.join(words.select(*one), f"w{i}")
    for first, last in [(1, k) for k in range(2, length)] + [(k, length) for k in range(2, length)]:
        name = counts[first, last] = f"n{first}_{last}"
        part = _of_length(found, last - first + 1, how)
        on = [f"w{i}" for i in range(first, last + 1)]
        rows = rows.join(part.select(*(F.col(f"w{i - first + 1}").alias(f"w{i}") for i in range(first, last + 1)), F.col("n").alias(name)), on)

    def cut(k: int) -> Column:
        left, right = counts[1, k], counts[k + 1, length]
        # Up to 10 ** 16 occurrences this is exact in 38 digits.
        score = F.expr(f"(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    lowest = F.array_min(F.array(*(cut(k) for k in range(1, length))))
    text = F.concat_ws(" ", *(f"word{i}" for i in range(1, length + 1)))
    return rows.select(*(f"w{i}" for i in range(1, length + 1)), "lang", text.alias("phrase"), "a", lowest.alias("cut")).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def mine(df: DataFrame, how: Phrases | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Words are what stands between blanks and tabs in the pieces between ``.,;:!?`` and line ends, A-Z lower-cased. A phrase of 2 to
    ``longest`` words of one piece is a candidate if it occurs ``a >= least`` times, overlaps included. Of its cuts into a first
    part, seen ``l`` times, and a rest, seen ``r`` times, the one with the lowest ``floor(1000000 a a / (l r))`` counts, the
    earliest of equal ones. Candidates that lie inside a longer one seen at least ``inside`` percent as often are left
    out. Rank is by score, then ``a``, descending, then the phrase's bytes. ``n`` is the number of the language's words.

    Null texts are empty, a null language is ``und``; rows count as often as they are repeated, ids only deal
    them out. Two frequent words of one 64-bit digest stop the job. Without candidates there are no rows; further columns
    are left out.
    """
    how = how or Phrases()
    found = frequent(df, how, id_column, text_column, lang_column)
    best = None
    for length in range(2, how.longest + 1):
        names = [f"w{i}" for i in range(1, length + 1)]
        rows = _scored(found, length, how)
        if length < how.longest:
            # A phrase inside one two words longer is inside one that is one longer, seen no less often.
            longer = _of_length(found, length + 1, how)
            part = lambda skip: longer.select(*(F.col(f"w{i + skip}").alias(f"w{i}") for i in range(1, length + 1)), "n")  # noqa: B023, E731
            around = part(0).unionByName(part(1)).groupBy(*names).agg(F.max("n").alias("around"))
            rows = rows.join(around, names, "left").filter(F.coalesce(100 * F.col("around") < how.inside * F.col("a"), F.lit(True)))
        rows = rows.select("lang", "phrase", "a", "l", "r", "score")
        best = rows if best is None else best.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = first.filter(F.col("rank") <= how.best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    words = found.filter("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.filter(F.col("rank") <= how.best).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
