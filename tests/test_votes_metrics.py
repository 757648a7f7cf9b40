import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.operators import metrics as mt
from tallymark.operators import votes as vt

MODELS = ["A.1", "B-2", "C"]


@pytest.fixture(scope="module")
def votes(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(200):
        for i, model in enumerate(MODELS):
            category = rng.choice(["x", "x", "x", "y", "z", "N/A", None])
            rows.append((doc, model, category, i))
            if doc % 10 == 0:  # a second, later vote
                rows.append((doc, model, "late", i + 100))
    df = spark.createDataFrame(rows, "doc int, model string, category string, seq int").repartition(5)
    first = {}
    for doc, model, category, seq in sorted(rows, key=lambda r: r[3]):
        first.setdefault((doc, model), category)
    return df, first


def wide_rows(df):
    return {r["doc"]: tuple(r[m] for m in MODELS) for r in df.collect()}


def test_wide_votes_take_the_first(votes):
    df, first = votes
    wanted = {doc: tuple(first[doc, m] for m in MODELS) for doc in range(200)}
    assert wide_rows(vt.wide_votes(df, ["doc"], MODELS, order="seq")) == wanted
    classes = ["x", "y", "z", "N/A", "late"]
    assert wide_rows(vt.wide_votes(df, ["doc"], MODELS, order="seq", classes=classes)) == wanted
    with pytest.raises(Exception, match="unknown class"):
        vt.wide_votes(df, ["doc"], MODELS, order="seq", classes=["x"]).collect()


def test_unanimity_counts_null_as_a_vote(spark):
    rows = [(1, "x", "x", "x"), (2, "x", None, "x"), (3, "N/A", "N/A", "N/A"), (4, None, None, None), (5, "x", "y", "x")]
    wide = spark.createDataFrame(rows, "doc int, `A.1` string, `B-2` string, C string")
    flags = wide.select("doc", vt.is_unanimous(MODELS).alias("u")).collect()
    assert {r.doc: r.u for r in flags} == {1: True, 2: False, 3: True, 4: True, 5: False}
    rate = vt.unanimity_rate(wide, MODELS).first()
    assert rate.messages == 3 and rate.unanimity == pytest.approx(2 / 3)
    classes = {r.category: (r.messages, r.total) for r in vt.unanimous_classes(wide, MODELS).collect()}
    assert classes == {"x": (1, 3), "N/A": (1, 3), None: (1, 3)}


def test_pairwise_agreement_ignores_nulls(votes):
    df, first = votes
    wide = vt.wide_votes(df, ["doc"], MODELS, order="seq")
    cells = {(r.model_a, r.model_b): r for r in vt.pairwise_agreement(wide, MODELS).collect()}
    assert len(cells) == 9
    for a in MODELS:
        for b in MODELS:
            pairs = [(first[d, a], first[d, b]) for d in range(200)]
            known = [p == q for p, q in pairs if p is not None and q is not None]
            wanted = 1.0 if a == b else sum(known) / len(known)
            assert cells[a, b].agreement == pytest.approx(wanted)
            assert cells[a, b].overlap_distance == pytest.approx(1 - wanted)


def test_many_models_agree_in_one_pass(spark):
    models = [f"m.{i}" for i in range(41)]
    rows = [(d, m, f"c{(d * 7 + i * d) % 3}", i) for d in range(20) for i, m in enumerate(models)]
    df = spark.createDataFrame(rows, "doc int, model string, category string, seq int")
    wide = vt.wide_votes(df, ["doc"], models, order="seq", classes=["c0", "c1", "c2"])
    assert vt.pairwise_agreement(wide, models).count() == 41 * 41
    assert vt.unanimity_rate(wide, models).first().messages == 20


def test_js_distance(spark):
    counts = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 1), ("b", "x", 3), ("b", "y", 1), ("c", "z", 4)],
        "model string, category string, votes long",
    )
    matrix = vt.counts_matrix(counts, ["a", "b", "c"])
    found = {(r.model_a, r.model_b): r.distance for r in vt.js_distance(matrix, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == pytest.approx(0.0, abs=1e-9)
    assert found["a", "c"] == pytest.approx(math.sqrt(math.log(2)))


def entropy(counts):
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts)


def test_entropies(votes):
    df, first = votes
    one = df.filter("seq < 100").na.fill("N/A", ["category"])
    by_key = {r.doc: r for r in vt.vote_entropy(one, ["doc"]).collect()}
    wide = vt.complete_rows(vt.wide_votes(one, ["doc"], MODELS, order="seq"), MODELS)
    by_row = {r.doc: r.e for r in wide.select("doc", vt.row_entropy(MODELS).alias("e")).collect()}
    for doc in range(200):
        counts = Counter(first[doc, m] or "N/A" for m in MODELS).values()
        assert by_key[doc].entropy == pytest.approx(entropy(counts), abs=1e-12)
        assert by_row[doc] == pytest.approx(entropy(counts), abs=1e-12)
        if len(counts) == 1:
            assert str(by_key[doc].entropy) == "0.0" and str(by_row[doc]) == "0.0"


def test_consistency_entropy_is_not_a_mean_of_entropies(spark):
    rows = [("m", 1, c) for c in ["x"] * 3 + ["y"]] + [("m", 2, c) for c in ["z"] * 2 + ["x"] * 2]
    df = spark.createDataFrame(rows, "model string, doc int, category string")
    found = vt.consistency_entropy(df, ["doc"]).first()
    assert found.entropy == pytest.approx(entropy([3 + 2, 1 + 2]))
    steady = spark.createDataFrame([("m", 1, "x")] * 4 + [("m", None, "y")] * 4, "model string, doc int, category string")
    assert str(vt.consistency_entropy(steady, ["doc"]).first().entropy) == "0.0"


def test_class_shares_sorted_by_class_total(spark):
    counts = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 3), ("b", "y", 2)], "model string, category string, votes long"
    )
    rows = [(r.model, r.category, r.share, r.class_share) for r in vt.class_shares(counts).collect()]
    assert rows == [("a", "y", 0.75, 1.75), ("b", "y", 1.0, 1.75), ("a", "x", 0.25, 0.25)]


def test_scores_against_definition(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(["a", "b", "N/A", None])) for _ in range(300)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, truth string, category string")
    found = mt.scores(mt.confusion(df, "truth", "category", ["model"]), ["model"]).first()
    seen = [(t, p) for t, p in rows if p is not None]
    n = len(seen)
    support = Counter(t for t, _ in seen)
    predicted = Counter(p for _, p in seen)
    hits = Counter(t for t, p in seen if t == p)
    recall = [hits[c] / support[c] for c in support]
    balanced = sum(recall) / len(recall)
    assert found.accuracy == pytest.approx(balanced)
    assert found.adjusted_accuracy == pytest.approx((balanced - 1 / 3) / (1 - 1 / 3))
    assert found.plain_accuracy == pytest.approx(sum(hits.values()) / n)
    # class c is never predicted: precision 0; N/A is only predicted: weight 0
    assert found.precision == pytest.approx(
        sum(support[c] * (hits[c] / predicted[c] if predicted[c] else 0) for c in support) / n
    )
    assert found.f1 == pytest.approx(sum(support[c] * 2 * hits[c] / (support[c] + predicted[c]) for c in support) / n)


def test_confusion_shares(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("b", "b")], "truth string, p string")
    shares = {(r.truth, r.predicted): r.share for r in mt.confusion_shares(mt.confusion(df, "truth", "p")).collect()}
    assert shares == {("a", "a"): 0.33, ("a", "b"): 0.67, ("b", "b"): 1.0}


def test_speed_and_failures_with_a_hot_model(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.choice(["N/A", "x", "x", None]),
             rng.choice([1.5, 1.5, rng.random() * 50, None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "model string, category string, duration double").repartition(6)
    for row in mt.speed_and_failures(df).collect():
        mine = [r for r in rows if r[0] == row.model]
        times = sorted(r[2] for r in mine if r[2] is not None)
        middle = (times[(len(times) - 1) // 2] + times[len(times) // 2]) / 2
        seen = [r[1] == "N/A" for r in mine if r[1] is not None]
        assert row.inference_duration == pytest.approx(middle)
        assert row.failure_rate == pytest.approx(100 * sum(seen) / len(seen))


def test_load_check_and_totals(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "model string")
    assert {(r["rows"], r.inputs) for r in vt.load_check(df).collect()} == {(2, 1), (1, 2)}
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "y", 5)], "model string, category string, votes long")
    assert [(r.category, r.votes) for r in vt.class_totals(counts).collect()] == [("y", 5), ("x", 3)]
    assert mt.mean_score(df.withColumn("s", F.lit(1.0)), "model", "s").count() == 3
