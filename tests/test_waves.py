"""Nearest rows in waves, and eigenvectors on little disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.learning import nearest as nn
from tallymark.learning import spectral, vectors, waves
from tallymark.learning.spectral import eigenvectors
from tallymark.session import shuffles_dropped

DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def some_rows():
    draw = np.random.default_rng(31)
    v = draw.normal(size=(230, 5)).round(2)
    # Copies, distances that tie in the order of keys as text, a key that comes twice, one that is null, and a negative one.
    v[40:48] = v[39]
    v[60:70] = np.tile([[50.0, 0, 0, 0, 0], [50.0, 1, 0, 0, 0]], (5, 1))
    rows = [(i if i != 229 else -7, [float(x) for x in row]) for i, row in enumerate(v)]
    return [*rows, (3, rows[9][1]), (None, rows[20][1]), (9_000_000_000, rows[20][1])]


def by_search(df, k):
    named = df.withColumn("name", F.col("id").cast("string"))
    found = nn.nearest(named, named, key="id", vector="v", label="name", k=k)
    return sorted(((r.a, r.b) for r in found.select(F.col("id").alias("a"), F.explode(F.col("neighbours.label").cast("array<bigint>")).alias("b")).collect()), key=str)


@pytest.mark.parametrize("k", [1, 6, 400])
def test_pairs_are_those_of_a_search(spark, monkeypatch, k):
    df = spark.createDataFrame(some_rows(), "id long, v array<double>").repartition(5)
    monkeypatch.setattr(waves, "MERGED_ROWS", 17)
    found = waves.nearest_pairs(df, df.count(), 5, key="id", vector="v", k=k, part_rows=31)
    assert sorted(((r.a, r.b) for r in found.collect()), key=str) == by_search(df, k)


def test_large_graphs_come_in_waves(spark, monkeypatch):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, components array<double>")
    wanted = {(r.a, r.b, r.weight) for r in vectors._neighbour_graph(df, "id", 4).collect()}
    monkeypatch.setattr(vectors, "CHUNKED_BYTES", 0)
    monkeypatch.setattr(vectors, "nearest", lambda *_, **__: pytest.fail("writes a row for each block that it looks at"))
    assert {(r.a, r.b, r.weight) for r in vectors._neighbour_graph(df, "id", 4).collect()} == wanted


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_eigenvectors_with_few_images_and_blocks_at_a_time(spark, monkeypatch, tmp_path, sent):
    draw = np.random.default_rng(32)
    n, weights = 150, np.zeros((150, 150))
    for i in range(n):
        for j in range(i):
            if j == 0 or draw.random() < (0.3 if i // 60 == j // 60 else 0.02):
                weights[i, j] = weights[j, i] = draw.choice([0.5, 1.0])
    edges = [(f"n{i}", f"n{j}", float(weights[i, j])) for i, j in zip(*np.nonzero(np.tril(weights)))]
    for name, value in (("BLOCK_ROWS", 20), ("PIECE_ROWS", 3), ("IMAGE_BYTES", 20_000), ("SHUFFLED_BYTES", 20_000), ("SENT_BYTES", sent)):
        monkeypatch.setattr(spectral, name, value)
    monkeypatch.setattr(spectral, "new_folder", lambda *_: str(tmp_path / "shared"))
    seen, products = [], spectral._products
    monkeypatch.setattr(spectral, "_products", lambda rows, width, blocks: seen.append(blocks) or products(rows, width, blocks))
    other = spectral._multiplied if sent else spectral._multiplied_by_sent
    monkeypatch.setattr(spectral, other.__name__, lambda *_: pytest.fail("the other way"))
    found, values = eigenvectors(spark.createDataFrame(edges, "a string, b string, weight double").repartition(5), 3)
    degree = weights.sum(axis=1)
    dense = weights / np.sqrt(np.outer(degree, degree))
    rows = {r.node: r.v for r in found.collect()}
    held = np.array([rows[f"n{i}"] for i in range(n)])
    assert np.allclose(values, np.linalg.eigvalsh(dense)[::-1][:3], atol=1e-3)
    assert np.abs(dense @ held - held * values).max() < 1e-3
    # Eight blocks, three at a time at most; as few images as are kept; the edges are packed only.
    assert max(seen) <= 3 and len(seen) % 3 == 0
    assert len(list((tmp_path / "shared").glob("image-*"))) == spectral.FEWEST_IMAGES
    assert spark.read.schema("a string").parquet(str(tmp_path / "shared" / "edges")).count() == 0


def test_shuffles_are_dropped_inside_only(spark):
    before = spark.conf.get(DROPPED)
    with pytest.raises(ValueError), shuffles_dropped(spark):
        assert spark.conf.get(DROPPED) == "true"
        raise ValueError
    assert spark.conf.get(DROPPED) == before
