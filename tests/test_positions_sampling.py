import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import positions as ps
from tallymark.operators import ranking as rk
from tallymark.operators import sampling as sm
from tallymark.operators import statistics as st
from tallymark.operators import votes as vt


def mark(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    # one class and one value hold a third of all rows or more
    return [(i, "hot" if rng.random() < 0.4 else rng.choice("abc"), 7 if rng.random() < 0.5 else rng.randint(0, 40))
            for i in range(3000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, kind string, size int").repartition(7)


def test_random_position(frame, rows):
    wanted = {k: i for i, k in enumerate(sorted((r[0] for r in rows), key=lambda k: (mark(k, 4), k)))}
    for parts in (1, 5):
        found = ps.with_random_position(frame.repartition(parts), "key", 4, digits=2)
        assert {r.key: r.position for r in found.collect()} == wanted


def test_position_in_groups_and_folds(frame, rows):
    found = {r.key: r.fold for r in sm.folds(frame, "kind", "key", 4, 9).collect()}
    assert len(found) == len(rows)
    for kind in {r[1] for r in rows}:
        keys = sorted((r[0] for r in rows if r[1] == kind), key=lambda k: (mark(k, 9), k))
        assert [found[k] for k in keys] == [i % 4 for i in range(len(keys))]


def test_chunks_by_value_split_ties(frame, rows):
    wanted = sorted(rows, key=lambda r: (r[2], mark(r[0], 0), r[0]))
    found = {r.key: r.chunk for r in ps.with_chunk_by_value(frame, "size", "key", 256).collect()}
    assert found == {r[0]: i // 256 for i, r in enumerate(wanted)}


def test_chunks_by_time_with_a_hot_moment(spark, rows):
    df = spark.createDataFrame(rows, "key long, kind string, size int")
    timed = df.withColumn("at", F.timestamp_seconds(F.when(F.col("size") == 7, -5364662400).otherwise(F.col("size") * 7000)))
    seconds = {r[0]: -5364662400 if r[2] == 7 else r[2] * 7000 for r in rows}
    wanted = sorted(seconds, key=lambda k: (seconds[k], mark(k, 0), k))
    found = {r.key: r.chunk for r in ps.with_chunk_by_time(timed, "at", "key", 100).collect()}
    assert found == {k: i // 100 for i, k in enumerate(wanted)}


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "key long, kind string")
    found = ps.with_random_position(df, "key", 0, group=["kind"]).collect()
    assert sorted(r.position for r in found if r.kind is None) == list(range(10))


def test_stratified_sample(frame, rows):
    for df in (frame, frame.select("key", "kind"), frame.repartition(2)):
        found = sm.stratified_sample(df, "kind", 25, "key", 2)
        assert found.columns and {c for c in df.columns} == set(found.columns)
        got = {r.key for r in found.collect()}
        for kind in {r[1] for r in rows}:
            keys = sorted((r[0] for r in rows if r[1] == kind), key=lambda k: (mark(k, 2), k))
            assert set(keys[:25]) == got & set(keys)


def test_sample_takes_small_strata_whole(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "key long, kind string")
    assert sm.stratified_sample(df, "kind", 5, "key", 0).count() == 3


def test_top_n_survives_a_hot_group(frame, rows):
    found = ps.top_n(frame, ["kind"], [F.desc("size"), F.asc("key")], 6, spread=3, rank="place")
    got = {(r.kind, r.place): r.key for r in found.collect()}
    for kind in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == kind), key=lambda r: (-r[2], r[0]))[:6]
        assert [got[kind, i + 1] for i in range(6)] == [r[0] for r in mine]


def test_order_statistics(frame, rows):
    found = st.values_at(frame, "size", {"v": st.nearest_rank(0.995)}).first()
    sizes = sorted(r[2] for r in rows)
    assert found.v == sizes[round((len(sizes) - 1) * 0.995)]
    medians = {r.kind: r.m for r in st.exact_median(frame, "size", ["kind"], "m").collect()}
    for kind, median in medians.items():
        mine = sorted(r[2] for r in rows if r[1] == kind)
        assert median == (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2


def test_order_statistics_of_negative_and_missing_values(spark):
    values = [None, -3.5, -3.4, 0.0, 2.0, None, 1e-9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    found = st.values_at(df, "v", {f"p{i}": (lambda i: lambda n: F.lit(i))(i) for i in range(6)}).first()
    assert [found[f"p{i}"] for i in range(6)] == known


def test_token_statistics_multiply_copies(spark):
    messages = [("s", "f", "b", 1)] * 3 + [("s", "f", "c", 1)] + [(None, "f", "b", 1)]
    df = spark.createDataFrame(messages, "subject string, `from` string, body string, date long")
    raw = df.withColumn("r", F.when(F.col("body") == "b", 10).otherwise(2))
    clean = df.withColumn("c", F.when(F.col("body") == "b", 5).otherwise(1))
    counts = st.joined_token_counts(raw, clean, "r", "c")
    assert {(x.r, x.c, x.pairs) for x in counts.collect()} == {(10, 5, 9), (2, 1, 1)}
    row = st.token_statistics(counts, "r", "c").first()
    assert (row.avg_clean, row.avg_raw, row.high_clean, row.high_raw) == (4, 9, 5, 10)


@pytest.mark.parametrize("size", [30, 200, 800])
def test_entropy_bands_overlap_in_small_frames(spark, size):
    models = ["a", "b", "c", "d"]
    rng = random.Random(size)
    rows = [(i, *[rng.choice("xyz") for _ in models]) for i in range(size)]
    wide = spark.createDataFrame(rows, "doc long, a string, b string, c string, d string").repartition(3)
    import math
    from collections import Counter

    def entropy(votes):
        return round(-sum(c / 4 * math.log(c / 4) for c in Counter(votes).values()), 9)

    mixed = [(entropy(r[1:]), r[0]) for r in rows if len(set(r[1:])) > 1]
    order = [k for _, k in sorted(mixed, key=lambda x: (-x[0], mark(x[1], 1), x[1]))]
    n, mid = len(order), len(order) // 2
    wanted = {(k, "high") for k in order[:150]} | {(k, "low") for k in order[max(n - 75, 0):]}
    wanted |= {(k, "middle") for k in order[max(mid - 75, 0): mid + 75]}
    found = {(r.doc, r.band) for r in sm.entropy_bands(wide, models, "doc", 1).collect()}
    assert found == wanted


def test_any_vote_sample_may_overlap(spark):
    rows = [(d, c) for d in range(100) for c in ("x", "y", "x")]
    votes = spark.createDataFrame(rows + [(1, None)], "doc long, category string")
    found = sm.any_vote_sample(votes, 10, "doc", 1).collect()
    first = sorted(range(100), key=lambda k: mark(k, 1))[:10]
    assert sorted((r.doc, r.category) for r in found) == sorted((d, c) for d in first for c in "xy")


def test_labelling_set_leaves_out_labelled(spark):
    models = ["a", "b"]
    rows = [(d, m, "x" if d % 3 else "xy"[i], i) for d in range(60) for i, m in enumerate(models)]
    votes = spark.createDataFrame(rows, "doc long, model string, category string, seq int")
    wide = vt.wide_votes(votes, ["doc"], models, order="seq")
    labelled = spark.createDataFrame([(d,) for d in range(10)], "doc long")
    found = sm.labelling_set(votes, wide, models, "doc", labelled).collect()
    assert len({r.doc for r in found}) == len(found) and min(r.doc for r in found) >= 10
    assert {r.doc for r in found} == set(range(10, 60))
    assert sum(r.reason == "agree" for r in found) == 10
    assert all(r.reason == "low" for r in found if r.doc % 3 == 0)


def test_labelling_queue(spark):
    docs = spark.createDataFrame([(d,) for d in range(50)], "doc long")
    queue = sm.labelling_queue(docs, "doc", 0)
    order = [r.doc for r in queue.orderBy("position").collect()]
    assert order == sorted(range(50), key=lambda k: mark(k, 0))
    assert sm.resume_queue(queue).count() == 50
    given = spark.createDataFrame([(order[3], "x"), (order[7], None)], "doc long, supervised_label string")
    merged = sm.merge_labels(queue, given, "doc")
    assert [r.position for r in sm.resume_queue(merged).orderBy("position").collect()] == list(range(4, 50))
    again = sm.merge_labels(merged, given.withColumn("supervised_label", F.lit(None).cast("string")), "doc")
    assert again.filter("supervised_label is not null").count() == 1


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 2.0)], "name string, s double")
    assert [r.name for r in rk.best(df, "s", 2, tie="name").collect()] == ["b", "c"]
    ranks = {r.name: r.rank_test_score for r in rk.with_rank(df, "s").collect()}
    assert ranks == {"b": 1, "c": 1, "d": 3, "a": 4}
    ends = {(r.side, r.place): r.name for r in rk.extremes(df, "s", 1, tie="name").collect()}
    assert ends == {("low", 1): "a", ("high", 1): "b"}
    arrays = spark.createDataFrame([(["x", "y", "z"], [0.2, 0.7, 0.1])], "n array<string>, v array<double>")
    top = arrays.select(rk.largest_entries(F.col("n"), F.col("v"), 2).alias("t")).first().t
    assert [(round(e.percent), e.category) for e in top] == [(70, "y"), (20, "x")]


def test_model_ranking_lowest_is_best(spark):
    rows = [("good", 1.0, 0.1, 0.9, 0.9), ("bad", 9.0, 0.9, 0.1, 0.1), ("skip", 1.0, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "model string, inference_duration double, entropy double, f1 double, accuracy double")
    found = rk.model_ranking(df).collect()
    assert [(r.model, round(r.weighted_average, 9)) for r in found] == [("good", 0.0), ("bad", 1.0)]
