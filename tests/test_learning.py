import json
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallymark import fixed
from tallymark.functions.keys import order_hash
from tallymark.learning import classifiers as cf
from tallymark.learning import diverse as kc
from tallymark.learning import grid as gr
from tallymark.learning import nearest as nn
from tallymark.learning import scoring as sc
from tallymark.learning import vectors as vc
from tallymark.plans import derive as dv

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def points(spark, sf):
    return dv.separable(spark, sf).cache()


def arrays(df):
    rows = df.orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), [r.label for r in rows]


def by_definition(train, test, labels, k, metric):
    out = []
    for row in test:
        if metric == "euclidean":
            d = np.sqrt(((train - row) ** 2).sum(1))
        elif metric == "manhattan":
            d = np.abs(train - row).sum(1)
        else:
            d = 1 - train @ row / (np.linalg.norm(train, axis=1) * np.linalg.norm(row))
        votes = defaultdict(float)
        for j in np.argsort(d, kind="stable")[:k]:
            votes[labels[j]] += 1 / d[j]
        out.append(max(sorted(votes), key=votes.get))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_neighbours_both_ways(points, metric):
    train, test = points.filter("vec_id % 3 = 0"), points.filter("vec_id % 3 > 0")
    _, tv, tl = arrays(train)
    ids, qv, _ = arrays(test)
    wanted = dict(zip(ids, by_definition(tv, qv, tl, 7, metric)))
    how = dict(label="label", key="vec_id", vector="embedding", k=7, metric=metric)
    sent = nn.classify(test, train, **how)
    assert {r.vec_id: r.prediction for r in sent.collect()} == wanted
    blocks = nn.classify(test, train, broadcast_bytes=0, block_rows=40, **how)
    assert {r.vec_id: r.prediction for r in blocks.collect()} == wanted


def test_exact_match_outvotes(spark):
    train = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.1, 0.0]), ("b", [0.0, 0.1])], "label string, v array<double>")
    test = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<double>")
    assert nn.classify(test, train, label="label", key="id", vector="v", k=3).first().prediction == "a"
    with pytest.raises(ValueError, match="no training rows"):
        nn.nearest(test, train.limit(0), label="label", key="id", vector="v", k=1)


def kcentre_by_definition(keys, vectors, starts, n):
    if len(keys) <= n:
        return set(keys)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    gaps = np.round(1 - np.array([[float(np.einsum("i,i->", a, b)) for b in unit] for a in unit]), 12)
    chosen = [int(np.argmin(starts))]
    near = gaps[chosen[0]].copy()
    for _ in range(n - 1):
        bound = np.sort(near)[int(len(keys) * 0.95)]
        free = [i for i in range(len(keys)) if i not in chosen]
        above = [i for i in free if near[i] >= bound]
        pick = min(above, key=lambda i: (near[i], keys[i])) if above else max(free, key=lambda i: (near[i], keys[i]))
        chosen.append(pick)
        near = np.minimum(near, gaps[pick])
    return {keys[i] for i in chosen}


def test_kcentre_both_ways(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        group = "hot" if i < 110 else "mid" if i < 155 else "tiny"
        vector = rng.normal(size=5) if i % 4 else np.ones(5)  # a quarter are copies
        rows.append((i, group, [float(x) for x in vector]))
    df = spark.createDataFrame(rows, "key long, kind string, v array<double>").repartition(5)
    starts = {r.key: r.h for r in df.select("key", order_hash("key", 0).alias("h")).collect()}
    wanted = set()
    for kind in ("hot", "mid", "tiny"):
        mine = [r for r in rows if r[1] == kind]
        order = sorted(range(len(mine)), key=lambda i: starts[mine[i][0]])
        rank = np.empty(len(mine))
        rank[order] = range(len(mine))
        wanted |= kcentre_by_definition([r[0] for r in mine], np.array([r[2] for r in mine]), rank, 9)
    how = dict(group="kind", key="key", vector="v", n=9)
    local = {r.key for r in kc.kcentre_sample(df, **how).collect()}
    assert local == wanted and len(local) == 9 + 9 + 5
    jobs = {r.key for r in kc.kcentre_sample(df, task_bytes=0, stride=3, **how).collect()}
    assert jobs == wanted
    mixed = {r.key for r in kc.kcentre_sample(df, task_bytes=60 * 5 * 24, stride=3, **how).collect()}
    assert mixed == wanted


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    weights = {r.label: r.weight for r in cf.class_weights(df, "label").collect()}
    assert weights == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}
    assert cf.with_class_weight(df, "label").agg(F.sum("weight")).first()[0] == pytest.approx(4.0)


def test_projection_centres_and_orders_variance(points):
    out = vc.project(points, "embedding", 5)
    found = np.array([r.components for r in out.collect()])
    assert found.shape[1] == 5 and np.allclose(found.mean(0), 0, atol=1e-9)
    _, vectors, _ = arrays(points)
    centred = vectors - vectors.mean(0)
    wanted = np.sort(np.linalg.eigvalsh(np.cov(centred.T)))[::-1][:5]
    assert np.allclose(found.var(0, ddof=1), wanted)
    with pytest.raises(ValueError, match="500 components"):
        vc.project(points, "embedding", 500)


@pytest.mark.parametrize("mode", ["kmeans", "agglomerative", "spectral"])
def test_clustering(points, mode):
    rows = vc.cluster(points, "vec_id", "embedding", mode=mode, k=4, columns=8).collect()
    assert len(rows) == points.count() and {r.cluster_mode for r in rows} == {mode}
    assert {r.cluster_label for r in rows} <= set(range(4)) and len({r.cluster_label for r in rows}) > 1


def test_grid_and_repeated_cv(points):
    grid = {"gnb": {}, "lr": {"C": [0.9], "penalty": ["l1", "l2"]}, "rf": {"n_estimators": [10], "max_depth": [None]},
            "svc": {"C": [0.1]}, "knn": {"n_neighbors": [15], "metric": ["manhattan"]}}
    found = gr.candidates(grid, [64, 250])
    assert len(found) == 12
    table = gr.grid_search(points, found, embedding="embedding", source="t", key="vec_id", label="label", k=2).collect()
    assert len(table) == 6 and table[0].mean_test_score == max(r.mean_test_score for r in table)
    assert {r.model for r in table} == set(grid)
    by_model = {r.model: r.mean_test_score for r in table}
    assert by_model["gnb"] > 0.4 and by_model["lr"] > 0.5 and by_model["svc"] > 0.5
    assert all(r.params["pca__n_components"] == "64" for r in table)
    again = gr.repeated_cv(points, [("gnb", {}, 64)], embedding="embedding", source="t", key="vec_id", label="label", k=2, repeats=2)
    rows = again.collect()
    assert sorted(r.iteration for r in rows) == [0, 1, 2, 3]
    assert all(0.4 < r.f1 <= 1 and 0.4 < r.accuracy <= 1 for r in rows)


def test_predict_rest_and_certainty(points):
    sample = points.filter("vec_id % 2 = 0")
    rest = points.filter("vec_id % 2 = 1")
    rows = gr.fit_and_predict(sample, rest, ("lr", {"C": 0.9, "penalty": "l2"}, 25), key="vec_id", vector="embedding", label="label").collect()
    assert len(rows) == rest.count()
    assert np.mean([r.truth == r.predicted for r in rows]) > 0.5
    for row in rows[:20]:
        p = row.probability.toArray()
        assert p.sum() == pytest.approx(1) and row.entropy == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum())


def test_user_embedding_model(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("a", 3), ("abc", 1), ("", 2)], "t string, n int")
    rows = vc.embed_with(df, "t", make, "v", tokens="n", batch_rows=2).collect()
    assert {r.t: list(r.v) for r in rows} == {"a": [1.0, 1.0], "abc": [3.0, 1.0], "": [0.0, 1.0]}


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "été chat chat"), (2, "chien"), (3, "chat")], "i int, t string")
    rows = {r.i: np.array(r.v) for r in vc.embed_hashed(df, "t", "v", 32).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in rows.values())


def predictor():
    def predict(prompt, model, temperature):
        if "boom" in prompt:
            raise RuntimeError("boom")
        return json.dumps({"class_label": fixed.CLASSES[0] if temperature == 0 else fixed.CLASSES[1],
                           "alternative_label": model.lower(), "subject_suggestion": "note"})

    return predict


def test_classification_of_pending_messages(spark):
    rows = [(1, "s", "f", "<b>fine</b>"), (2, "s", "f", "boom"), (3, None, "f", "<i></i>")]
    df = spark.createDataFrame(rows, "id int, subject string, `from` string, body string").withColumn(
        "date", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    prompt = {r.id: r.prompt for r in sc.prompts(df).collect()}
    assert "Date: 2024-01-02" in prompt[1] and "fine" in prompt[1] and "<b>" not in prompt[1]
    assert "Subject: None" in prompt[3] and "<i></i>" in prompt[3] and fixed.CLASSES[8] in prompt[3]
    done = spark.createDataFrame([(1, "a"), (2, "b")], "id int, model string")
    found = {(r.id, r.model): r for r in sc.classify_pending(df, ["a", "b"], done, predictor, key="id").collect()}
    assert set(found) == {(1, "b"), (2, "a"), (3, "a"), (3, "b")}
    assert found[1, "b"].primary_category == fixed.CLASSES[0] and found[1, "b"].alternative_category == "b"
    failed = found[2, "a"]
    assert failed.primary_category == failed.subject_suggestion == failed.alternative_category == "N/A"
    assert all(r.inference_duration >= 0 for r in found.values())


def test_repeat_scoring(spark):
    rows = [(i, "s", "f", "x", "k" if i < 8 else "l") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, subject string, `from` string, body string, truth string").withColumn(
        "date", F.lit(None).cast("timestamp"))
    out = sc.repeat_scoring(df, ["a", "b"], predictor, key="id", label="truth", per_class=3, resamples=4)
    got = out.groupBy("truth", "model").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("n"), F.max("primary_category").alias("c")).collect()
    assert {(r.truth, r.ids, r.n) for r in got} == {("k", 3, 12), ("l", 2, 8)}
    assert {r.c for r in got} == {fixed.CLASSES[1]}
