"""Certainty of classifiers that give margins or votes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.learning import calibration as ca
from tallymark.learning import grid as gr
from tallymark.learning import nearest as nn


@pytest.fixture(scope="module")
def overlapping(spark):
    draws = np.random.default_rng(3)
    centres = {"a": (0, 0, 0), "b": (1.6, 0, 0), "c": (0, 1.6, 0.5)}
    names = ["a"] * 150 + ["b"] * 90 + ["c"] * 60
    rows = [(i, [float(x) for x in draws.normal(centres[n], 1.0)], n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").cache()


@pytest.mark.parametrize("winner", [("svc", {"C": 1.0, "kernel": "linear"}, 3), ("knn", {"n_neighbors": 25, "metric": "euclidean"}, 3)])
def test_probabilities_beat_the_class_prior(overlapping, winner):
    sample, rest = overlapping.filter("vec_id % 2 = 0"), overlapping.filter("vec_id % 2 = 1")
    rows = gr.fit_and_predict(sample, rest, winner, key="vec_id", vector="embedding", label="label").collect()
    p = np.array([r.probability.toArray() for r in rows])
    # Alphabetical order of the classes.
    own = np.array(["abc".index(r.truth) for r in rows])
    assert len(rows) == rest.count() and np.allclose(p.sum(1), 1)
    share = np.bincount(own) / len(own)
    loss = -np.log(np.clip(p[np.arange(len(own)), own], 1e-6, 1)).mean()
    assert loss < -np.log(share[own]).mean() - 0.1
    assert np.allclose([r.entropy for r in rows], -(p * np.log(np.clip(p, 1e-300, 1))).sum(1))


def test_curves_are_the_least_loss(spark):
    draws = np.random.default_rng(5)
    own = draws.integers(0, 2, 400)
    margins = np.stack([draws.normal(1 - 2 * own, 1.5), draws.normal(2 * own - 1, 0.7)], 1)
    df = spark.createDataFrame([(float(o), m.tolist()) for o, m in zip(own, margins)], "y double, margins array<double>")
    for c, (a, b) in enumerate(ca.fit_curves(df, "y", 2)):
        n = int((own == c).sum())
        t = np.where(own == c, (n + 1) / (n + 2), 1 / (400 - n + 2))
        p = 1 / (1 + np.exp(-(a * margins[:, c] + b)))
        assert a > 0 and abs(((p - t) * margins[:, c]).mean()) < 1e-6 and abs((p - t).mean()) < 1e-6


def test_separated_classes_and_classes_without_margins(spark):
    df = spark.createDataFrame([(0.0, [1.0]), (0.0, [1.0]), (1.0, [-1.0]), (1.0, [-1.0])], "y double, margins array<double>")
    (a, b), none = ca.fit_curves(df, "y", 2)
    assert np.isfinite([a, b]).all() and a > 0 and none == (0.0, 0.0)


def test_shares_of_votes(spark):
    df = spark.sql("select array(named_struct('distance', 1d, 'label', 'x'), named_struct('distance', 2d, 'label', 'y')) as n union all select array(named_struct('distance', 0d, 'label', 'y'), named_struct('distance', 2d, 'label', 'x'))")
    shares = [r.s for r in df.select(nn.vote_shares(F.col("n"), ["x", "y", "z"]).alias("s")).collect()]
    assert shares == [[pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0], [0.0, 1.0, 0.0]]
