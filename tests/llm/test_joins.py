"""Operators that bring rows together: similarity join, mixing, top-k, revisits, licenses, components."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import licenses, mixing, revisits, shingle_join, topk
from tallymark.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(40)] + [(5, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = roots({n for p in links if p[0] != p[1] for n in p}, links)
    assert found == wanted
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def set_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def family(draw, base, copies, edits):
    for _ in range(copies):
        words = base[:]
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"e{draw.random()}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    fresh = lambda n: [f"w{draw.randrange(300)}" for _ in range(n)]
    passage = fresh(40)
    texts = [None, "", " \t", "One", "one", "two words", "Two  words", "a b c d", "a b c D"]
    texts += [" ".join(fresh(draw.randint(1, 60))) for _ in range(60)]
    texts += [" ".join([*fresh(draw.randint(0, 12)), *passage, *fresh(draw.randint(0, 12))]) for _ in range(60)]
    for size, copies, edits in ((150, 90, 6), (60, 30, 3), (25, 20, 2), (9, 12, 1), (400, 12, 20)):
        texts += family(draw, fresh(size), copies, edits)
    texts += [texts[-1]] * 40
    return texts


@pytest.mark.parametrize("join", [shingle_join.Join(), shingle_join.Join(counter_bits=12, frequent=3, very_frequent=24, small=2)])
def test_join_by_hand(spark, corpus, join):
    sets = [set_of(t) for t in corpus]
    ids = [1000 - i for i in range(len(corpus))]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                    links.append((ids[i], ids[j]))
    wanted = roots(ids, links)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, corpus)], "doc_id long, text string, node string, component_id int").repartition(5)
    rows = shingle_join.link_documents(docs, join).collect()
    assert {r.doc_id: r.component_id for r in rows} == wanted and len(rows) == len(corpus)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in zip(ids, sets)}
    if join == shingle_join.Join():
        kept = shingle_join.keep_one(docs, join)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in wanted.items() if i == c)


def test_signatures_share_a_key():
    """Sets that link have a key in common, whatever the frequencies."""
    draw = np.random.default_rng(3)
    join = shingle_join.Join(counter_bits=10)
    for trial in range(400):
        n = int(draw.integers(1, 120))
        base = draw.integers(0, 2**63, n + 40).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.unique(shingle_join.mix(base))
        levels = draw.choice(np.array([0, 1, 3, 9], np.uint8), 1 << 10, p=[0.3, 0.3, 0.2, 0.2] if trial % 2 else [0, 0.5, 0.2, 0.3])
        a, b = base[:n], base[int(draw.integers(0, max(1, n // 8))) : n + int(draw.integers(0, max(1, n // 8)))]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            keys = [shingle_join.signatures(s, levels, join)[0] for s in (a, b)]
            assert len(np.intersect1d(*keys))


def test_join_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert shingle_join.link_documents(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (7, "A b c d E"), (None, None)], schema)
    rows = shingle_join.link_documents(docs).collect()
    assert sorted(map(str, rows)) == sorted(
        map(str, shingle_join.link_documents(docs.repartition(3)).collect())
    ) and [r.component_id for r in rows if r.n_shingles] == [3, 3, 3, 3]
    assert sorted(str(r.doc_id) for r in shingle_join.keep_one(docs).collect()) == ["3", "None", "None"]


def test_mix_meets_its_target(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(1, 30)), None if i % 11 == 0 else "big" if i % 3 else f"s{i % 5}", "x") for i in range(3000)]
    rows += [(5000, None, "big", "x"), (5001, "", "empty", "x"), (5002, "  ", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string").repartition(7)
    sizes, words = {}, {i: len((t or "").split()) for i, t, _, _ in rows}
    for i, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + words[i]
    del sizes["empty"]
    total = sum(sizes.values())

    def weights(a):
        powers = {s: (n / total) ** a for s, n in sizes.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    entropy = lambda w: -sum(p * math.log(p) for p in w.values())
    target = (entropy(weights(1)) + math.log(len(sizes))) / 2
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(weights(middle)) > target else (low, middle)
    mix = mixing.Mix()
    drawn = mixing.draw(docs, mix).select("row.doc_id", "row.source", "mix_tokens", "mix_epoch", "mix_block", "mix_repeat", "mix_at").collect()
    for source, weight in weights(high).items():
        mine = [r for r in drawn if r.source == source]
        budget = round(weight * total)
        got = sum(r.mix_tokens for r in mine)
        assert budget - 1 <= got <= budget + 31
        # Whole epochs hold every document once, the last one each at most once.
        whole = budget // sizes[source]
        times = {}
        for r in mine:
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        own = [i for i, _, s, _ in rows if s == source and words[i]]
        assert all(whole <= times.get(i, 0) <= whole + 1 for i in own)
        assert all(0 <= r.mix_at <= 1 and r.mix_repeat == budget / sizes[source] for r in mine)
    again = mixing.draw(docs.repartition(3), mix).select("row.doc_id", "row.source", "mix_tokens", "mix_epoch", "mix_block", "mix_repeat", "mix_at").collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))
    limited = mixing.draw(docs, mixing.Mix(repeat_limit=1.5, budget=total)).select("row.source", "mix_tokens").collect()
    for source, size in sizes.items():
        assert sum(r.mix_tokens for r in limited if r.source == source) <= 1.5 * size + 31
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.draw(docs.filter("false")).count() == 0


def test_topk_by_hand(spark):
    draw = np.random.default_rng(5)
    vectors = {i: draw.normal(0, 0.13, 16) for i in range(300)}
    vectors |= {i: vectors[7] for i in range(300, 400)}
    rows = [(i, v.tolist(), "x", 1) for i, v in vectors.items()]
    odd = [(400, None), (420, [1.0, None] * 8), (440, [float("nan")] * 16), (460, [float("inf")] + [0.0] * 15), (None, [0.1] * 16)]
    rows += [(i, v, "x", 1) for i, v in odd] + [rows[20]]
    found = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, packed string, score int").repartition(4)).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.array(list(vectors))
    whole = np.floor(64 * np.stack(list(vectors.values()))).astype(int)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for q, ranks in found.items():
        scores = whole @ whole[ids == q][0]
        others = ids != q
        order = np.lexsort((ids[others], -scores[others]))[:20]
        assert [ranks[k + 1] for k in range(20)] == list(zip(ids[others][order], scores[others][order]))


@pytest.mark.parametrize("scale", [1, 10**4, 10**9])
def test_topk_stays_exact_for_large_numbers(scale):
    draw = np.random.default_rng(6)
    objects, queries = draw.integers(-scale, scale + 1, (500, 8)), draw.integers(-scale, scale + 1, (20, 8))
    ids = np.arange(500)
    query, vec, score = topk.best_of_cell(ids, objects, np.arange(20) + 1000, queries, 5)
    for i, q in enumerate(queries):
        exact = [int(sum(int(x) * int(y) for x, y in zip(o, q))) for o in objects]
        best = sorted(range(500), key=lambda j: (-exact[j], j))[:5]
        assert vec[query == i + 1000].tolist() == best and score[query == i + 1000].tolist() == [exact[j] for j in best]


def test_topk_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    rows = topk.search(spark.createDataFrame([(0, [1.0]), (1, [0.5, 2.0]), (3, [])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 64 * 32), (0, 2, 3, 0)]


def captures():
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        # One URL holds a third of all records.
        url = "http://hot.example.com/p" if i % 3 == 0 else f"https://www.site{draw.randrange(40)}.example.org/a/{draw.randrange(4)}/"
        kind = draw.choice(["response", "revisit", "revisit"])
        headers = {"etag": draw.choice(['"a"', 'W/"a"', '"b"']), "date": str(i)} if draw.random() < 0.7 else {"last-modified": draw.choice("xy")} if draw.random() < 0.6 else None
        rows.append((i, url + draw.choice(["", "#f", "?utm_source=q"]), draw.randrange(400), kind, headers, draw.choice([None, "d1", "d2"]), f"body{i}" if kind == "response" else None))
    return rows + [(2000, None, 5, "revisit", None, None, None), (2001, "http://x.example/", 5, None, {}, None, None)]


def test_revisits_by_hand(spark):
    rows = captures()
    schema = "record_id long, url string, at long, kind string, headers map<string,string>, digest string, payload string, site string"
    records = spark.createDataFrame([(*r, "clash") for r in rows], schema).withColumn("captured_at", F.timestamp_seconds("at")).repartition(6)
    found = {r.record_id: r for r in revisits.resolve(records).collect()}
    assert len(found) == len(rows)
    site = lambda u: u and re.sub(r"[#?].*$", "", re.sub(r"^https?://(www\.)?", "", u)).rstrip("/")
    weak = lambda t: t and re.sub("^W/", "", t)
    responses = [r for r in rows if r[3] == "response"]
    for r in rows:
        got = found[r[0]]
        if r[3] == "response":
            assert got.resolution == "full" and got.payload == r[6]
            continue
        earlier = [x for x in responses if r[1] and site(x[1]) == site(r[1]) and x[2] <= r[2]]
        if not earlier:
            assert got.resolution == "missing" and got.payload is None
            continue
        last = max(earlier, key=lambda x: (x[2], x[0]))
        own, theirs = r[4] or {}, last[4] or {}
        verdict = "unproven"
        for name, a, b in (("etag", weak(own.get("etag")), weak(theirs.get("etag"))), ("last-modified", own.get("last-modified"), theirs.get("last-modified")), ("digest", r[5], last[5])):
            if a is not None and b is not None:
                verdict = name if a == b else "mismatch"
                break
        assert (got.resolution, got.response_id) == (verdict, last[0])
        if verdict in ("etag", "last-modified", "digest"):
            assert got.payload == last[6] and dict(got.headers) == {**theirs, **{k: v for k, v in own.items() if k in revisits.PERMITTED}}
        else:
            assert got.payload is None
    assert revisits.resolve(records.filter("false")).count() == 0


def test_canonical_urls(spark):
    same = ["HTTP://www.Example.com:80/a/?b=2&utm_source=x&a=1#top", "https://example.com/a?a=1&b=2", "https://user@example.com/a/?a=1&&b=2&gclid=3"]
    rows = spark.createDataFrame([(u,) for u in [*same, None, ""]], "u string").select(revisits.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["example.com/a?a=1&b=2"] * 3 + [None, ""]


def test_links_of_int_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[51:]])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.component_id for r in shingle_join.link_documents(docs).collect()} == {0}
    assert [r.doc_id for r in shingle_join.keep_one(docs).collect()] == [0]


def test_licenses_of_few_words(spark):
    docs = spark.createDataFrame([(1, "the MIT license, here"), (2, "SPDX-License-Identifier: ISC"), (3, "# spdx-license-identifier: BSD-3-Clause\n"), (4, "a license of MIT")], "doc_id long, text string")
    found = licenses.scan(docs, [*licenses.TEMPLATES, *licenses.SHORT_TEMPLATES]).collect()
    assert {(r.doc_id, r.license, r.first_word) for r in found} == {(1, "MIT", 0), (2, "ISC", 0), (3, "BSD-3-Clause", 0)}
    with pytest.raises(Exception, match="no words"):
        licenses.scan(docs, [("none", "--")])


def test_licenses_by_hand(spark):
    draw = random.Random(8)
    fresh = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    wanted, rows = {}, []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{fresh(draw.randint(0, 90))} {text.upper()} {fresh(draw.randint(0, 90))}"))
        wanted[i] = name
    rows += [(100, None), (101, ""), (102, "MIT License"), (103, fresh(300)), (0, rows[0][1])]
    long_text = fresh(30_000) + " " + licenses.TEMPLATES[4][1]
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, (104, long_text)]], "doc_id long, text string, license string")
    found = licenses.scan(docs).collect()
    assert {(i, n) for i, n in wanted.items()} <= {(r.doc_id, r.license) for r in found if r.containment == 1}
    assert {r.doc_id for r in found} == {*wanted, 104}
    assert len(found) == len({(r.doc_id, r.license) for r in found})
    assert licenses.scan(docs.filter("false")).count() == 0 and licenses.scan(docs, templates=[]).count() == 0
