"""Quality rules on repetition inside a text, by a suffix array over words.

All texts of a batch share one suffix array: the text's number is the first sort key,
so suffixes of different texts never meet. Ranks are refined by prefix doubling, and
only suffixes that are still tied are sorted again. The ranks of each doubling give the
longest common prefix of neighbours in the array. The deepest LCP interval around a
suffix is the longest substring starting there that occurs again; the spans of these
intervals cover exactly what the maximal repeated substrings cover, since any shorter
interval holding the suffix is a prefix of its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.tables import SPACE, map_rows, map_whole, slices

SYMBOLS = "#*$%&|<>"
_NO_SPACE = SPACE.encode()
_NO_SYMBOL = SYMBOLS.encode()


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a text is rejected when it passes one.

    ``least_words`` and ``repeated_percent`` (words in windows of ``window`` words that occur
    twice) are the base. Repeats of at least ``least_repeat`` words count as covered;
    more than ``covered_percent`` of the words may not be. No repeat may be longer than
    ``longest_repeat`` words unless it is under ``longest_percent`` of the text.
    """

    least_words: int = 10
    window: int = 5
    repeated_percent: int = 20
    least_repeat: int = 8
    covered_percent: int = 18
    longest_repeat: int = 60
    longest_percent: int = 10


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def longest_repeats(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word of the texts laid end to end: words of the longest substring starting there that its text holds twice."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[text]
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    held = key[order]
    fresh = np.r_[True, held[1:] != held[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels = [rank.astype(np.int32)]
    tied = np.r_[~fresh[1:], False] | ~fresh
    active = order[tied]
    h = 1
    while len(active):
        later = active + h
        inside = later < end[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[later[inside]] + 1
        first = rank[active]
        key = first * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, first, key = active[order], first[order], key[order]
        at = np.arange(len(active))
        opens = np.r_[True, first[1:] != first[:-1]]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(opens, at, 0))
        rank[active] = first + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        levels.append(rank.astype(np.int32))
        active = active[np.r_[~fresh[1:], False] | ~fresh]
        h *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    near = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])
    a, b = suffix[near], suffix[near + 1]
    common = np.zeros(len(a), np.int64)
    last = np.minimum(end[a] - a, end[b] - b)
    for level in range(len(levels) - 1, -1, -1):
        ranks, step = levels[level], 1 << level
        fits = np.flatnonzero(common + step <= last)
        same = fits[ranks[a[fits] + common[fits]] == ranks[b[fits] + common[fits]]]
        common[same] += step
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered_words(starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in the union of the spans (``starts`` as in the texts laid end to end)."""
    n = int(sizes.sum())
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    inside = np.cumsum(steps[:n]) > 0
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(text[inside], minlength=len(sizes))


def _line_repeats(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def measure(texts: list[str | None], rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The measures of each text, then whether the base rules reject it and whether it is kept."""
    numbers, table = [], _Ids()
    found = {name: np.zeros(len(texts), np.int64) for name in MEASURES}
    for i, text in enumerate(texts):
        if not text:
            numbers.append(np.empty(0, np.int64))
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        numbers.append(np.array(list(map(table.__getitem__, words)), np.int64))
        found["n_words"][i] = len(words)
        found["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, _NO_SPACE)))
        found["n_symbols"][i] = len(raw) - len(raw.translate(None, _NO_SYMBOL))
        found["n_dup_lines"][i] = _line_repeats(text)
    sizes = found["n_words"]
    if sizes.sum():
        longest = longest_repeats(np.concatenate(numbers), sizes)
        windows = np.flatnonzero(longest >= rules.window)
        found["n_repeat_words"] = covered_words(windows, np.full(len(windows), rules.window), sizes)
        spans = np.flatnonzero(longest >= rules.least_repeat)
        found["covered_words"] = covered_words(spans, longest[spans], sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        np.maximum.at(found["longest_repeat"], text, longest)
    base_failed = (sizes < rules.least_words) | (100 * found["n_repeat_words"] > rules.repeated_percent * sizes)
    too_covered = 100 * found["covered_words"] > rules.covered_percent * sizes
    too_long = (found["longest_repeat"] > rules.longest_repeat) & (100 * found["longest_repeat"] > rules.longest_percent * sizes)
    return found, base_failed, ~(base_failed | too_covered | too_long)


def score_documents(df: DataFrame, rules: Rules | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the measures, ``base_failed`` and ``kept``.

    A null text has no words, as an empty one: it fails the base. Null ids stay null,
    repeated rows are measured each, further columns are left out.
    """
    rules = rules or Rules()

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1):
            found, base_failed, kept = measure(piece.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), *(pa.array(found[m]) for m in MEASURES), pa.array(base_failed), pa.array(kept)],
                ["doc_id", *MEASURES, "base_failed", "kept"],
            )

    schema = "doc_id long, " + "".join(f"{m} long, " for m in MEASURES) + "base_failed boolean, kept boolean"
    return map_rows(df, [id_column, text_column], score, schema)


def keep_documents(df: DataFrame, rules: Rules | None = None, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that pass the rules, with all their columns as they were.

    Rows with a null, empty or short text fail. Repeated rows are judged alike.
    """
    rules = rules or Rules()
    at = df.columns.index(text_column)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, at):
            _, _, kept = measure(piece.column(at).to_pylist(), rules)
            yield piece.filter(pa.array(kept))

    return map_whole(df, keep)
