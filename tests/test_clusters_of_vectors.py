"""Spectral clustering against a dense solver, average linkage against a tree cut by hand."""

import tracemalloc

import numpy as np
import pytest

from tallymark.learning import linkage, spectral
from tallymark.learning.linkage import average_linkage
from tallymark.learning.spectral import eigenvectors
from tallymark.learning.vectors import cluster


def same_parts(a, b):
    return {frozenset(i for i, x in a.items() if x == c) for c in set(a.values())} == {frozenset(i for i, x in b.items() if x == c) for c in set(b.values())}


def test_eigenvectors_of_planted_blocks(spark):
    draw = np.random.default_rng(9)
    n, blocks = 240, 4
    block = draw.integers(0, blocks, n)
    weights = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            if draw.random() < (0.25 if block[i] == block[j] else 0.01):
                weights[i, j] = weights[j, i] = draw.choice([0.5, 1.0])
    edges = [(int(i), int(j), float(weights[i, j])) for i, j in zip(*np.nonzero(np.tril(weights)))]
    found, values = eigenvectors(spark.createDataFrame(edges, "a long, b long, weight double").repartition(5), 6)
    degree = weights.sum(axis=1)
    dense = weights / np.sqrt(np.outer(degree, degree))
    wanted, vectors = np.linalg.eigh(dense)
    assert np.allclose(values, wanted[::-1][:6], atol=1e-3)
    rows = {r.node: r.v for r in found.collect()}
    held = np.array([rows[i] for i in range(n)])
    assert np.allclose(held.T @ held, np.eye(6), atol=1e-6)
    # The four planted directions span what the dense solver finds; the fifth is apart from them.
    overlap = np.linalg.svd(held[:, :blocks].T @ vectors[:, ::-1][:, :blocks])[1]
    assert overlap.min() > 1 - 1e-4


def test_small_graphs(spark):
    found, values = eigenvectors(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0), (7, 8, 2.0)], "a long, b long, weight double"), 9)
    # Two parts: the value 1 twice, and -1 twice as both have two sides.
    assert len(values) <= 5 and values[:2] == pytest.approx([1, 1], abs=1e-6)
    assert found.count() == 5


def test_eigenvectors_of_many_blocks_of_nodes(spark, monkeypatch, tmp_path):
    draw = np.random.default_rng(14)
    n, weights = 150, np.zeros((150, 150))
    for i in range(n):
        # Groups of unlike sizes, one node with an edge to every other, and a loop.
        for j in range(i):
            if j == 0 or draw.random() < (0.3 if i // 60 == j // 60 else 0.02):
                weights[i, j] = weights[j, i] = draw.choice([0.5, 1.0])
    weights[7, 7] = 2.0
    edges = [(f"n{i}", f"n{j}", float(weights[i, j])) for i, j in zip(*np.nonzero(np.tril(weights)))]
    monkeypatch.setattr(spectral, "BLOCK_ROWS", 20)
    monkeypatch.setattr(spectral, "PIECE_ROWS", 3)
    monkeypatch.setattr(spectral, "new_folder", lambda *_: str(tmp_path / "shared"))
    found, values = eigenvectors(spark.createDataFrame(edges, "a string, b string, weight double").repartition(5), 3)
    degree = weights.sum(axis=1)
    dense = weights / np.sqrt(np.outer(degree, degree))
    rows = {r.node: (r.degree, r.v) for r in found.collect()}
    held = np.array([rows[f"n{i}"][1] for i in range(n)])
    assert np.allclose([rows[f"n{i}"][0] for i in range(n)], degree)
    assert np.allclose(values, np.linalg.eigvalsh(dense)[::-1][:3], atol=1e-3)
    assert np.abs(dense @ held - held * values).max() < 1e-3
    # Images of one round only, each of eight bytes for a node and vector, however many rounds there are.
    sizes = [spark.read.parquet(str(path)).selectExpr("sum(length(x))").first()[0] for path in (tmp_path / "shared").glob("image-*")]
    assert len(sizes) == spectral.IMAGES and set(sizes) == {8 * n * (3 + spectral.SPARE)}


def test_spectral_mode_recovers_rings(spark):
    draw = np.random.default_rng(10)
    angle = draw.uniform(0, 2 * np.pi, 160)
    radius = np.where(np.arange(160) % 2 == 0, 1.0, 6.0) + draw.normal(size=160) * 0.05
    rows = [(i, [float(r * np.cos(a)), float(r * np.sin(a))]) for i, (r, a) in enumerate(zip(radius, angle))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {r.id: r.cluster_label for r in cluster(df, "id", "v", mode="spectral", k=2, columns=2).collect()}
    assert same_parts(found, {i: i % 2 for i in range(160)})


def linkage_by_hand(vectors, k):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = 1 - units @ units.T
    parts = [[i] for i in range(len(units))]
    while len(parts) > k:
        pairs = [(far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts[:i])]
        _, i, j = min(pairs)
        parts[j] += parts.pop(i)
    return {i: c for c, part in enumerate(parts) for i in part}


@pytest.mark.parametrize("last", [40, 500])
def test_average_linkage_is_the_tree_cut(spark, last):
    draw = np.random.default_rng(11)
    vectors = np.concatenate([draw.normal(size=(120, 5)), draw.normal(size=(6, 1, 5)).repeat(10, 1).reshape(60, 5) * 3 + draw.normal(size=(60, 5)) * 0.2])
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    # A copy, and the same direction at another length, go with their first.
    rows += [(500, rows[3][1], "x"), (501, [2 * x for x in rows[4][1]], "x"), (502, None, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, head string").repartition(5)
    both = np.concatenate([vectors, vectors[3:4], 2 * vectors[4:5]])
    for k in (7,) if last == 40 else (3, 11):
        found = average_linkage(df, "v", k, last=last)
        assert found.columns == ["id", "v", "head", "cluster_label"]
        labels = {r.id: r.cluster_label for r in found.collect()}
        assert labels.pop(502) is None
        wanted = linkage_by_hand(both, k)
        wanted = {i if i < 180 else 320 + i: c for i, c in wanted.items()}
        assert same_parts(labels, wanted) and set(labels.values()) == set(range(k))


@pytest.mark.parametrize("few", [0, 60])
def test_rounds_of_chunks_and_of_few_cut_the_same_tree(spark, monkeypatch, few):
    draw = np.random.default_rng(12)
    vectors = np.concatenate([draw.normal(size=(60, 4)), draw.normal(size=(4, 1, 4)).repeat(15, 1).reshape(60, 4) * 2 + draw.normal(size=(60, 4)) * 0.3])
    # Chunks that meet, rounds of chunks alone, and rounds of few whose changes are written more than once.
    for name, size in (("CHUNK_ROWS", 30), ("PIECE_ROWS", 7), ("AGAINST_ROWS", 11), ("FEW", few)):
        monkeypatch.setattr(linkage, name, size)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(5)
    labels = {r.id: r.cluster_label for r in average_linkage(df, "v", 6, last=60 if not few else 20).collect()}
    assert same_parts(labels, linkage_by_hand(vectors, 6))


def test_memory_of_nearest_clusters_follows_a_piece():
    draw = np.random.default_rng(13)
    heads, means = np.arange(40_000), draw.normal(size=(40_000, 4))
    tracemalloc.start()
    inner, place = linkage._best(heads[:400], means[:400], heads, means)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = means[:400] @ means.T
    table[np.arange(400), np.arange(400)] = -np.inf
    assert np.allclose(inner, table.max(axis=1)) and (place == table.argmax(axis=1)).all()
    # A table of all pairs has 128 MB.
    assert most < 30e6


def test_few_directions(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert {r.id: r.cluster_label for r in average_linkage(df, "v", 5).collect()} in ({1: 0, 2: 0, 3: 1}, {1: 1, 2: 1, 3: 0})
    assert average_linkage(df.limit(0), "v", 3).count() == 0
