"""Centroid clustering in whole numbers against a version with Python's own integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallymark.llm import centroids


def by_hand(rows, k, rounds, width, scale=64.0, seed=1):
    kept = []
    for key, vector in rows:
        if vector is None or len(vector) != width or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(scale * x) for x in vector]))
    starts = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), q) for key, q in kept if key is not None)[:k]
    at = [q for _, q in starts]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        held = {}
        for _, q in kept:
            held.setdefault(nearest(q)[1], []).append(q)
        for c, own in held.items():
            at[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(key, *nearest(q)[::-1]) for key, q in kept] if at else []
    inertia = {c: sum(d for _, i, d in found if i == c) for c in range(len(at))}
    total = sum(inertia.values())
    return sorted((str(key), c, d, inertia[c], total, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for key, c, d in found)


def found(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, vector string").repartition(parts)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster_vectors(df, **how).collect())


def vectors(draw, n, width, spread=1.0):
    return [(i, [draw.gauss(draw.choice([-1, 0, 1]), 0.3) * spread for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e12])
def test_rounds_by_hand(spark, spread):
    draw = random.Random(4)
    rows = vectors(draw, 150, 5, spread)
    if spread > 1e9:
        # Distances beyond 64 bits can't be returned; these are large but near each other.
        rows = [(i, [3e10 + x / 1e12 for x in v]) for i, v in rows]
    rows += [(7, rows[7][1])] * 20 + [(8, rows[9][1]), (None, rows[3][1]), (900, None), (901, [1.0] * 4), (902, [None] * 5), (903, [1.0, 2.0, math.nan, 0.0, 0.0]), (904, [math.inf] * 5), (905, [])]
    how = dict(k=6, rounds=3, width=5)
    assert found(spark, rows, **how) == by_hand(rows, 6, 3, 5)
    assert found(spark, rows, parts=9, **how) == found(spark, rows, parts=1, **how)


def test_few_rows_and_ties(spark):
    same = [(i, [0.5, 0.25]) for i in range(4)]
    assert found(spark, same, k=3, rounds=2, width=2) == by_hand(same, 3, 2, 2)
    # Equal centroids: all rows go to the first, the others stay empty.
    assert {r[1] for r in found(spark, same, k=3, rounds=2, width=2)} == {0}
    few = [(1, [0.1, 0.2]), (2, [3.0, 3.0])]
    assert found(spark, few, k=16, rounds=3, width=2) == by_hand(few, 16, 3, 2)
    assert found(spark, [], k=4, rounds=2, width=2) == []
    assert found(spark, [(None, [1.0, 2.0])], k=4, rounds=2, width=2) == []


def test_distance_beyond_64_bits_is_an_error(spark):
    rows = [(i, [x, 0.0]) for i, x in enumerate([1e12, -1e12, 1e12 + 1, 5.0])]
    with pytest.raises(OverflowError, match="beyond 64 bits"):
        found(spark, rows, k=1, rounds=1, width=2)


def test_tables_grow_with_the_values():
    draw = np.random.default_rng(5)
    at = draw.integers(-50, 50, (4, 3))
    tables = centroids.Tables(at)
    for low, high in ((0, 5), (-40, 60), (-3000, 3000), (-(1 << 25), 1 << 25), (1, 2)):
        rows = draw.integers(low, high, (200, 3))
        wanted = ((rows[:, None, :] - at[None]) ** 2).sum(axis=2)
        assert (tables.distances(rows) == wanted).all()
        near, far = tables.assign(rows)
        assert (near == wanted.argmin(axis=1)).all() and (far == wanted.min(axis=1)).all()
