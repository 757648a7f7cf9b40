"""Operators that learn: toxicity and page text; and the pipeline."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import dom, labelled_pages, page_text, toxicity
from tallymark.llm.counters import SCHEMA, add_up, pack
from tests.conftest import SF


def test_counters_add_up(spark):
    size = 3 * 65_536 + 100
    rows = spark.range(12).repartition(5).mapInArrow(lambda it: (pack(np.bincount([i, 70_000, size - 1], minlength=size) * 40_000) for b in it for i in b.column(0).to_pylist()), SCHEMA)
    total = add_up(rows, size)
    assert total[:12].tolist() == [40_000] * 12 and total[70_000] == total[-1] == 480_000 and total.sum() == 36 * 40_000


def segments_by_hand(scores, low=0, high=None):
    high = len(scores) if high is None else high
    best = None
    for i in range(low, high):
        for j in range(i + 1, high + 1):
            total = scores[i:j].sum()
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j, total)
    if best is None:
        return []
    return segments_by_hand(scores, low, best[0]) + [best] + segments_by_hand(scores, best[1], high)


def test_segments_by_hand():
    draw = np.random.default_rng(1)
    for _ in range(400):
        scores = draw.normal(-0.3, 1.5, draw.integers(0, 14))
        found = toxicity.maximal_segments(scores)
        assert [s[:2] for s in found] == [s[:2] for s in segments_by_hand(scores)]
        assert np.allclose([s[2] for s in found], [s[2] for s in segments_by_hand(scores)])
    assert len(toxicity.maximal_segments(np.tile([1.0, -2.0], 200_000))) == 200_000


def test_rate_solves_its_equation():
    scores, counts = np.array([-0.5, 2.0]), np.array([990.0, 10.0])
    rate = toxicity._solve_rate(scores, counts)
    assert (counts / 1000 * np.exp(rate * scores)).sum() == pytest.approx(1, abs=1e-6)


@pytest.fixture(scope="module")
def mail(spark):
    draw = random.Random(2)
    bad = ["grobian", "dolt", "wretch", "scoundrel"]
    docs, labels = [], []
    for i in range(700):
        words = [f"w{int(draw.paretovariate(0.7)) % 3000}" for _ in range(draw.randint(5, 120))]
        words = ["".join("abcdefghij"[int(c)] if c.isdigit() else c for c in w) for w in words]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(draw.randint(2, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", "s", "ish", "."]))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    docs += [(800, None, "x"), (801, "", "x"), (802, "wretch " * 50_000, "x"), (None, "dolt", "x"), (3, docs[3][1], "x")]
    labels += [(900, 1), (None, 1), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, mail):
    docs, labels = mail
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 705 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 700]
    right = sum(r.predicted == (r.doc_id % 7 == 0) for r in held)
    assert right >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[800].score == by_id[801].score < 0.5 and by_id[802].predicted == 1


def test_toxicity_never_sees_held_out_labels(spark, mail):
    docs, labels = mail
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{(r.doc_id, r.score) for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_rows(spark, mail):
    docs, labels = mail
    few = docs.limit(5)
    assert toxicity.score(few, toxicity.train(few, labels.filter("false"))).filter("score between 0 and 1").count() == 5
    none = docs.filter("false")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_broken_markup():
    page = dom.parse('<p>a<b>c<p class="x y">d<!-- <p> --><ul><li>e<li>f</ul></div><script>var s="</p>";</script>&amp;g<td>h')
    assert [page.tag[page.parent[n]] for n in page.text] == ["p", "b", "p", "li", "li", "#page", "td"]
    assert list(page.text.values()) == ["a", "c", "d", "e", "f", "&g", "h"]
    for source in (None, "", "<", "<<<>>>", "<p", "</p>", "<!--", "<a b='", "<script>", "<" * 5000, '<a b="' * 300):
        dom.parse(source)


@pytest.mark.parametrize("n", [100, 30_000, 300_000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes(n, quote):
    page = dom.parse(f"<div data-x={quote}{'x' * n}<p>leak</p></article><script>{quote} class=a id='b' data-y=main title=it's>body</div><i>end")
    assert page.text == {2: "body", 4: "end"} and page.tag == ["#page", "div", "#text", "i", "#text"]
    assert page.marks[1] == " a b" and page.given[1] == "main"


def test_quotes_that_never_close():
    assert list(dom.parse('<p class="x>a</p><b>c').text.values()) == ["a", "c"]
    started = time.perf_counter()
    for source in ("<a b=\"c>" * 50_001, "<a b='" * 100_000 + ">", "<a " * 100_000 + ">", '<a b="">' * 50_000 + "<a b='", "<a b=" * 100_000 + ">"):
        dom.parse(source)
    assert time.perf_counter() - started < 20


@pytest.mark.parametrize("start", ["<svg><path d=x>", "<svg><g><title>", "<math>", "<noscript>", "<template>", "<xmp>"])
def test_unclosed_elements_keep_the_page(start):
    assert list(dom.parse(f"<p>a</p>{start}<article><p>b<i>c</i></article>").text.values()) == ["a", "b", "c"]


def test_elements_whose_text_is_seen():
    page = dom.parse("<p>a<svg><path/><g/></svg>b <math><mi>x</mi><mo/></math> c<noscript>d</noscript></p><xmp>e</xmp>")
    assert [(page.tag[page.parent[n]], t.strip()) for n, t in page.text.items()] == [("p", "a"), ("p", "b"), ("mi", "x"), ("p", "c"), ("noscript", "d"), ("xmp", "e")]


@pytest.mark.parametrize("name", ["script", "STYLE", "title", "textarea", "iframe"])
def test_end_tags_after_letters_that_grow(name):
    page = dom.parse("\u0130" * 20 + f"<{name}>x</{name.lower()}ed></{name.lower()} ><p>short</p><p>last</p>")
    assert list(page.text.values())[1:] == ["short", "last"]


@pytest.fixture(scope="module")
def page_model(spark):
    return page_text.train(labelled_pages.labelled(spark))


def test_marginals_by_enumeration(page_model):
    """Messages give what summing over all states of a small page gives."""
    page = dom.parse("<nav><a>x</a></nav><article><p>some words here</p></article>")
    forest = page_text.plant([page])
    found = page_text.marginals(forest, page_model)
    kinds, kind = page_text._feature_rows(forest)
    size = page_text._size_features(forest.edge == 0, forest.words, forest.linked)
    n = len(page.parent)
    own = np.array([sum((page_model.features.get(f, np.zeros(3)) for f in [*kinds[kind[v]], f"size:{size[v]}"]), np.zeros(3)) for v in range(n)])
    weight = np.zeros((n, 3))
    for code in range(3**n):
        states = [code // 3**v % 3 for v in range(n)]
        total = page_model.root[states[0]] + sum(own[v][states[v]] for v in range(n))
        total += sum(page_model.edges[forest.edge[v]][states[page.parent[v]]][states[v]] for v in range(1, n))
        for v in range(n):
            weight[v][states[v]] += np.exp(total)
    assert np.allclose(found, weight / weight.sum(1, keepdims=True))


def test_words_after_long_marks(page_model):
    long_list = " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    # Of the words beyond the old cut and of the same words alone the same comes out.
    known = sorted(f[5:] for f in page_model.features if f.startswith("mark:"))
    assert known
    for word in known:
        features = page_text._element_features("div", f" {long_list} {word}", page_model.features)
        assert features == page_text._element_features("div", f" {word}", page_model.features) == ["tag:div", f"mark:{word}"]


def test_pages_of_other_layouts(spark, page_model):
    pages = [
        ("<body><div class='topnav'><a href=1>Home</a> <a href=2>News</a></div><div class=wrapper><div class='story-body'><h1>Title</h1><p>First text, with more.</p><p>Second&nbsp;one <i>goes</i> o<b>n</b>.</p></div></div><div class=footer>Copyright</div>", "Title First text, with more. Second one goes on."),
        ("<header><h1>Site</h1><nav><ul><li><a href=a>A</a></ul></nav></header><article><h1>T</h1><p>One is here.</p><div id=comments><p>Nice post!</p></div></article><footer><p>foot</p></footer>", "T One is here."),
        ("", ""),
        (None, ""),
    ]
    # Pages made with another seed have other words, sizes and surroundings.
    rows = [(i, None, h, "clash") for i, (h, _) in enumerate(pages)]
    found = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string"), page_model).orderBy("page_id").collect()
    assert [r.text for r in found] == [t for _, t in pages] and [r.n_chars for r in found] == [len(t) for _, t in pages]
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), page_model).count() == 0


def test_labelled_pages_of_another_seed(page_model):
    sources = labelled_pages.pages(seed=99)
    forest = page_text.plant([dom.parse(s) for s in sources])
    state = np.concatenate([page_text._states(p) for p in forest.pages])
    texts = forest.edge == 0
    kept = page_text.marginals(forest, page_model)[:, page_text.MAIN] > 0.5
    assert (kept == (state == page_text.MAIN))[texts].mean() > 0.97


def test_pipeline_drops_near_copies_of_five_words(spark):
    words = [f"w{i}" for i in range(97)]
    copy = [*words]
    copy[30], copy[60] = "x", "y"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [1]


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = corpus_pipeline.read(spark, SF, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= ids and (name != "secret scans" or now == ids)
        docs, ids = kept, now
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= ids and len(rows) > len(ids) // 2
