"""Phrase mining against plain counts, with whole and small corpora."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import collocations
from tallymark.llm.collocations import Phrases


def by_hand(rows, how):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, how.longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= how.least}
    found = {}
    for (lang, words), a in held.items():
        inside = any(
            b_lang == lang and len(b) > len(words) and 100 * f >= how.inside * a and any(b[i : i + len(words)] == words for i in range(len(b)))
            for (b_lang, b), f in held.items()
        )
        if not inside:
            cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[: how.best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(draw, n):
    pool = [f"w{i}" for i in range(40)] + ["É", "é", "New", "york", "a-b", "|", "x\x1cy"]
    fixed = ["new york city", "as well as", "ha ha ha ha ha", "one two three four five"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 25)):
            parts.append(draw.choice(fixed) if draw.random() < 0.2 else draw.choice(pool[: draw.choice([3, 8, 47])]))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r\n", "!?"]))
        out.append((i, "".join(parts), draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return out + [(None, None, "en"), (None, "", None), (3, " \t", "de")] + [(5, "the same row again", "fr")] * 12


def mined(spark, rows, how, parts=5):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, n int, word string, w1 int").repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(df, how).collect())


@pytest.mark.parametrize("how", [Phrases(), Phrases(shards=1, least=3), Phrases(shards=4, least=5, longest=4, best=30), Phrases(shards=3, least=2, longest=2, inside=0)])
def test_by_hand(spark, how):
    rows = corpus(random.Random(13), 250)
    wanted = by_hand(rows, how)
    assert wanted and mined(spark, rows, how) == wanted


def test_shards_and_partitions_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(14), 120)
    how = Phrases(least=4)
    wanted = by_hand(rows, how)
    assert mined(spark, rows, how, parts=1) == wanted
    # Few slots: most phrases begin for nothing, counts stay.
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    assert mined(spark, rows, Phrases(least=4, shards=3), parts=7) == wanted


def test_each_phrase_is_counted_for_one_cycle():
    how = Phrases(shards=3)
    active = [np.full(1 << 16, collocations.IDLE, np.uint8) for _ in range(2)]
    words = collocations.word_hashes([b"a", b"b"], b"en")
    slots = collocations.Scan(0, how, active)._slots(words)
    counted = []
    for step in range(7):
        # Between scans one word, then the other is found often enough.
        if step in (1, 2):
            active[0][slots[step - 1]] = step
        scan = collocations.Scan(step, how, active)
        scan.add(b"a b. a b", b"en")
        rows = [r for b in scan.rows() for r in b.to_pylist()]
        counted.append((sum(r["n"] for r in rows if r["word"]), [(r["n"], r["start"]) for r in rows if r["w2"] is not None]))
    assert counted == [(4, []), (4, []), (4, [(2, 2)]), (0, [(2, 2)]), (0, [(2, 2)]), (0, []), (0, [])]


def test_long_texts_and_empty_tables(spark, monkeypatch):
    draw = random.Random(15)
    long = " ".join(draw.choice(["a", "b", "c", "d.", "e"]) for _ in range(200_000))
    rows = [(1, long, "en"), (2, "x" * 500_000 + " y", "en"), *[(3, "y y y", "en")] * 10]
    wanted = by_hand(rows, Phrases())
    monkeypatch.setattr(collocations, "STRETCH", 1000)
    assert mined(spark, rows, Phrases()) == wanted
    empty = collocations.mine(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    assert mined(spark, [(1, None, None), (2, "few words", "en")], Phrases()) == []


def test_scores_beyond_64_bits(spark):
    rows = [(1, 2, None, 0, None, None, 4 * 10**15), (1, None, None, 0, "a", "en", 5 * 10**15), (2, None, None, 0, "b", "en", 7 * 10**15), (None, None, None, 0, None, "en", 10**16)]
    found = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, start int, word string, lang string, n long").drop("start")
    row = collocations._scored(found, 2, Phrases()).first()
    assert (row.a, row.l, row.r, row.score) == (4 * 10**15, 5 * 10**15, 7 * 10**15, 10**6 * 16 // 35)
