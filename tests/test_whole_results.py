"""Nothing is cut in silence: ties, null classes, wide matrices, header chunks, component counts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import fixed
from tallymark.learning import diverse, grid, nearest, vectors
from tallymark.functions.numbers import value_bucket
from tallymark.operators import sampling, statistics, votes
from tallymark.sources import mail


def test_tied_neighbours_in_any_order(spark):
    draw = random.Random(1)
    rows = [(i, [float(draw.randint(0, 2)), float(draw.randint(0, 1))], f"c{draw.randint(0, 3)}") for i in range(240)]
    train = spark.createDataFrame(rows, "key long, v array<double>, label string")
    test = train.limit(30)
    how = {"key": "key", "vector": "v", "label": "label", "k": 7}
    for metric in ("euclidean", "manhattan", "cosine"):
        results = []
        for frame in (train, train.orderBy(F.rand(3)), train.repartition(5, "label")):
            for extra in ({}, {"broadcast_bytes": 0, "block_rows": 32}):
                found = nearest.nearest(test, frame, metric=metric, **how, **extra).collect()
                results.append({r.key: [(round(n.distance, 9), n.label) for n in r.neighbours] for r in found})
        assert all(r == results[0] for r in results)
    exact = nearest.nearest(test, train, metric="euclidean", **how).collect()
    assert all(r.neighbours[0].distance == 0 for r in exact)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_equal_vectors_are_exact_matches(spark, metric):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=48).tolist(), str(i)) for i in range(100)]
    train = spark.createDataFrame(rows, "key long, v array<double>, label string")
    found = nearest.nearest(train, train, key="key", vector="v", label="label", k=3, metric=metric).collect()
    assert all(r.neighbours[0].distance == 0 and r.neighbours[0].label == r.label for r in found)


def test_one_vector_repeated_fills_many_blocks(spark):
    train = spark.range(400).select(F.array(F.lit(1.0), F.lit(0.0)).alias("v"), F.lit("a").alias("label"), "id")
    sizes = train.select(F.pmod(F.monotonically_increasing_id(), F.lit(10)).alias("b")).groupBy("b").count().collect()
    assert len(sizes) == 10
    found = nearest.nearest(train.limit(5), train, key="id", vector="v", label="label", k=3, broadcast_bytes=0, block_rows=40)
    assert all(len(r.neighbours) == 3 for r in found.collect())


def test_null_class_is_sampled(spark):
    draw = np.random.default_rng(3)
    rows = [(i, None if i % 6 == 0 else f"c{i % 3}", draw.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    for n, bytes_ in ((10, 1 << 30), (5, 1 << 30), (5, 1)):
        found = diverse.kcentre_sample(df, group="g", key="id", vector="v", n=n, task_bytes=bytes_).groupBy("g").count().collect()
        assert {r.g: r["count"] for r in found} == {None: n, "c0": n, "c1": n, "c2": n}


def test_more_strata_than_any_switch(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("s"), F.col("id") % 1500).alias("s"))
    found = sampling.stratified_sample(df, "s", 3, "id", 1)
    assert found.groupBy("s").count().filter("count <> 3").count() == 0 and found.count() == 4500


def test_components_beyond_the_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=64).tolist(), str(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    with pytest.raises(ValueError):
        vectors.project(df, "v", 250)
    with pytest.raises(ValueError):
        grid.score_candidates(df, [("gnb", {}, 400)], key="id", vector="v", label="y", k=2)
    with pytest.raises(ValueError):
        vectors.vector_width(df.union(spark.createDataFrame([(99, [1.0], "0")], df.schema)), "v")
    found = grid.grid_search(df, [("gnb", {}, s) for s in (2, 250, 400)], embedding="v", source="x", key="id", label="y", k=2).collect()
    assert [r.params["pca__n_components"] for r in found] == ["2"]
    stored = grid.as_text({"max_depth": None, "n_estimators": 50}, 10)
    assert stored["model__max_depth"] == "30" and grid.from_text(stored) == ({"max_depth": 30, "n_estimators": 50}, 10)


def test_all_models_agree_by_hand(spark):
    models = list(fixed.DISPLAY_NAMES.values())
    assert len(models) == 41
    draw = random.Random(5)
    rows = [[draw.choice(["a", "b", "c", None]) for _ in models] for _ in range(200)]
    wide = spark.createDataFrame(rows, ", ".join(f"`{m}` string" for m in models)).repartition(4)
    found = {(r.model_a, r.model_b): r.agreement for r in votes.pairwise_agreement(wide, models).collect()}
    assert len(found) == 41 * 41
    for i, a in enumerate(models):
        for j, b in enumerate(models):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            wanted = 1.0 if i == j else sum(x == y for x, y in both) / len(both)
            assert found[a, b] == pytest.approx(wanted)
    none = votes.pairwise_agreement(wide.filter("false"), models[:3]).collect()
    assert len(none) == 9 and sum(r.agreement == 1 for r in none) == 3


def test_all_models_distance_by_hand(spark):
    models = list(fixed.DISPLAY_NAMES.values())
    draw = np.random.default_rng(6)
    counts = draw.integers(0, 5, (11, 41))
    counts[:, 7] = 0
    matrix = spark.createDataFrame([(f"c{i}", *map(int, row)) for i, row in enumerate(counts)], "category string, " + ", ".join(f"`{m}` long" for m in models))
    found = {(r.model_a, r.model_b): r.distance for r in votes.js_distance(matrix, models).collect()}
    assert len(found) == 41 * 40 // 2
    shares = counts / np.maximum(counts.sum(0), 1)
    for (a, b), distance in found.items():
        p, q = shares[:, models.index(a)], shares[:, models.index(b)]
        if p.sum() and q.sum():
            parts = [x * np.log(2 * x / (x + y)) for x, y in [*zip(p, q), *zip(q, p)] if x > 0]
            assert distance == pytest.approx(np.sqrt(max(sum(parts) / 2, 0)), abs=1e-9)


def test_no_message_ends_the_job(spark):
    message = lambda **h: "".join(f"{k}: {v}\n" for k, v in h.items()).encode() + b"\nbody"
    part = b"Content-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=%s\nContent-Transfer-Encoding: 8bit\n\n%s\n--B--\n"
    cases = [
        message(Date="Fri, 31 Dec 9999 23:59:59 -0500"),
        message(Subject="=?utf-8?b?a?="),
        None,
        message(From="=?utf-8?q?J=C3=BCrgen?= <a@example.org>"),
        message(Subject="=?utf-8?q?one?= =?utf-8?q?_two?= three"),
        part % (b"shift_jis", "日本語です".encode("shift_jis")),
        part % (b"iso-8859-2", "žluťoučký".encode("iso-8859-2")),
        part % (b"no-such-charset", b"\xff\xfe"),
        b"",
        b"Content-Type: multipart/mixed\nContent-Disposition: attachment; filename*=bad''%zz\n\nx",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id long, content binary")
    rows = {r.id: r for r in mail.parse_messages(df, keep=("id",)).collect()}
    assert len(rows) == len(cases)
    assert rows[0].date.year == 1800 and rows[2]["from"] == "" and rows[2].size == 0
    assert rows[1].subject == "=?utf-8?b?a?="
    assert rows[3]["from"] == "Jürgen <a@example.org>" and rows[4].subject.split() == ["one", "two", "three"]
    assert rows[5].body.strip() == "日本語です" and rows[6].body.strip() == "žluťoučký" and rows[7].body.strip() == "ÿþ"
    assert mail.decode_header_text("=?utf-8?q?J=C3=BCrgen?= <a@example.org>", first_chunk=True) == "Jürgen"
    assert mail.parse_date("1 Jan 2024 00:00:00 +0100") == dt.datetime(2023, 12, 31, 23, tzinfo=dt.timezone.utc)


def test_value_buckets_spread_and_never_fall(spark):
    draw = np.random.default_rng(7)
    small = draw.uniform(1e-9, 1e-3, 100_000)
    values = [*small.tolist(), 0.0, -0.0, 1.0, 2.0, 1e300, float("inf"), 5e-324, *(-small[:100]).tolist(), -3.5, *(2.0**k for k in range(-60, 60))]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", value_bucket(F.col("x")).alias("b"))
    rows = sorted((r.x, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert df.groupBy("b").count().agg(F.max("count")).first()[0] < 2_000
    found = statistics.exact_median(df, "x", [], "m").first().m
    assert found == pytest.approx(np.median(values))
