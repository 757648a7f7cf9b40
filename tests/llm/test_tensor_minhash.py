"""Tensored MinHash against all pairs, and the numbers it chooses."""

import math
import random
import re

import numpy as np
import pytest

from tallymark.llm import tensor_minhash
from tallymark.llm.shingle_join import shingles
from tests.llm.test_joins import family, roots


def set_of(text, words=2):
    held = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(held[i : i + words]) for i in range(max(1, len(held) - words + 1))) if held else frozenset()


def wanted(ids, texts, percent=80):
    sets, links = [set_of(t) for t in texts], []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                    links.append((ids[i], ids[j]))
    return roots(ids, links), sets


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(12)
    fresh = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    passage = fresh(60)
    texts = [None, "", " \t", "One", "one", "two words", "Two  words", "a b c", "A b C", "a\x0bb\x0cc", "a\x1cb", "É é", "é É"]
    texts += [" ".join(fresh(draw.randint(1, 60))) for _ in range(60)]
    texts += [" ".join([*fresh(draw.randint(0, 30)), *passage, *fresh(draw.randint(0, 30))]) for _ in range(60)]
    # Many of these families' members link with some of the others only.
    for size, copies, edits in ((150, 90, 14), (60, 30, 6), (25, 20, 3), (9, 12, 1), (400, 12, 40), (5000, 3, 200)):
        texts += family(draw, fresh(size), copies, edits)
    texts += [texts[-1]] * 30
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("near", [tensor_minhash.Near(), tensor_minhash.Near(unrelated=0.3), tensor_minhash.Near(percent=60)])
def test_all_pairs(spark, corpus, near):
    ids = [2000 - 3 * i for i in range(len(corpus))]
    component, sets = wanted(ids, corpus, near.percent)
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in zip(ids, corpus)], "doc_id long, text string, node string, sub int, kept boolean").repartition(5)
    rows = tensor_minhash.link_documents(docs, near).collect()
    assert len(rows) == len(corpus)
    assert {r.doc_id: r.component_id for r in rows} == component
    assert {r.doc_id: r.n_shingles for r in rows} == dict(zip(ids, map(len, sets)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_nulls_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " more"
    rows = [(None, text), (None, None), (5, text), (5, text), (5, "other words here"), (9, near), (9, near), (9, near), (3, None), (3, "")]
    found = tensor_minhash.link_documents(spark.createDataFrame(rows, "doc_id int, text string").repartition(6)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(
        [("None", 39, "5", False), ("None", 0, "None", True), ("5", 39, "5", True), ("5", 39, "5", True), ("5", 2, "5", True), *[("9", 40, "5", False)] * 3, ("3", 0, "3", True), ("3", 0, "3", True)]
    )
    empty = tensor_minhash.link_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_numbers_follow_from_the_rows():
    near, widths = tensor_minhash.Near(), []
    for rows in (0, 1, 1000, 10**6, 10**9, 10**12):
        tables = near.tables(rows)
        assert tables.misses(0.8) <= 1e-6 < tensor_minhash.Tables(tables.width, tables.subs - 1).misses(0.8)
        assert rows * near.unrelated**tables.width <= 0.25
        widths.append(tables.width)
    assert widths == sorted(widths)
    # Far fewer minhashes than tables of their own would take.
    tables = near.tables(250_000)
    separate = 1
    while (1 - 0.8 ** (2 * tables.width)) ** separate > near.miss:
        separate += 1
    assert tables.subs * tables.width * 5 < separate * 2 * tables.width


def test_minhashes_estimate_similarity():
    factors = tensor_minhash.multipliers(1500)
    assert len(set(factors.tolist())) == 1500
    a, b = (" ".join(f"w{i}" for i in range(s, s + 3000)) for s in (0, 600))
    x, y = (tensor_minhash.minhashes(shingles(t, 2), factors) for t in (a, b))
    assert (x == (shingles(a, 2)[:, None] * factors).min(axis=0)).all()
    assert abs((x == y).mean() - 2399 / 3599) < 4 * math.sqrt(0.25 / 1500)
    tables = tensor_minhash.Tables(3, 500)
    rows = tensor_minhash.sub_signatures(np.array([x, y, x]), tables)
    assert (rows[0] == rows[2]).all() and ((rows[0] == rows[1]) == (x == y).reshape(500, 3).all(axis=1)).all()
    # Equal minhashes at another place are another sub-signature.
    same = tensor_minhash.sub_signatures(np.zeros((1, 6), np.uint64), tensor_minhash.Tables(3, 2))[0]
    assert same[0] != same[1]
