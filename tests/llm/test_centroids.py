"""Centroid clustering against a plain model."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import centroids


def brute(rows, k, rounds, scale, dims):
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cents = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [min(range(len(cents)), key=lambda c: (far(x, cents[c]), c)) for _, x in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(cents)):
            mine = [x for (_, x), a in zip(kept, of) if a == c]
            if mine:
                cents[c] = [sum(v) // len(mine) for v in zip(*mine)]
    of = assign()
    d = [far(x, cents[a]) for (_, x), a in zip(kept, of)]
    sums = [sum(v for v, a in zip(d, of) if a == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, a, v, sums[a], sum(d), sha[a]) for (i, _), a, v in zip(kept, of, d)], key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string, x int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, 0, 1, "d", 2) for i, e in rows], SCHEMA).repartition(parts, "vec_id")


@pytest.mark.parametrize("kind", ["clouds", "ties", "small"])
def test_clusters_against_a_plain_model(spark, monkeypatch, kind):
    monkeypatch.setattr(centroids, "BLOCK", 37)
    r = random.Random(4)
    if kind == "clouds":
        mid = [[r.gauss(0, 1) for _ in range(4)] for _ in range(9)]
        rows = [(i, [v + r.gauss(0, 0.3) for v in r.choice(mid)]) for i in range(400)]
    elif kind == "ties":  # a lattice: many equal distances, repeated vectors
        rows = [(i, [float(r.randrange(3)) for _ in range(4)]) for i in range(300)]
    else:
        rows = [(i, [float(i), 0.0, 0.0, -1.5]) for i in range(3)]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4)]
    got = centroids.cluster_vectors(frame(spark, rows), 8, 4, 2.0, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 8, 4, 2.0, 4)


def test_huge_components_are_exact(spark):
    r = random.Random(6)
    rows = [(i, [float(r.choice([-1, 1]) * 10 ** r.randrange(9)) for _ in range(2)]) for i in range(60)]
    got = centroids.cluster_vectors(frame(spark, rows), 5, 3, 4.0, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 5, 3, 4.0, 2)


def test_repeated_and_null_ids_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (2, [9.0, 9.0])]
    got = centroids.cluster_vectors(frame(spark, rows, 1), 2, 2, 1.0, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 2, 2, 1.0, 2)
    assert centroids.cluster_vectors(frame(spark, rows).limit(0)).collect() == []
    assert centroids.cluster_vectors(frame(spark, [(1, None)])).collect() == []


def test_gaps_are_never_above_the_true_ones():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-50, 50, (200, 3)), rng.integers(-50, 50, (6, 3))
    own, gap = centroids.nearest(x, c)
    d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
    true = np.sort(d, 1)
    assert (own == d.argmin(1)).all() and (gap <= true[:, 1] - true[:, 0]).all()
    after = c + rng.integers(-3, 4, c.shape)
    moved = np.sqrt(((x[:, None] - after) ** 2).sum(2))
    rest = moved.copy()
    rest[np.arange(200), own] = np.inf
    assert (gap - centroids.drifts(c, after)[own] <= rest.min(1) - moved[np.arange(200), own] + 1e-9).all()


def test_most_vectors_are_not_rescanned(spark, monkeypatch):
    """Far clouds: after the first step only few gaps expire."""
    r = random.Random(8)
    mid = [[r.gauss(0, 50) for _ in range(4)] for _ in range(6)]
    rows = [(i, [v + r.gauss(0, 0.5) for v in mid[i % 6]]) for i in range(600)]
    df = frame(spark, rows)
    kept = df.selectExpr("vec_id", "transform(embedding, e -> floor(e)) AS x").mapInArrow(centroids._pack, centroids._STATE)
    start = np.array([[math.floor(v) for v in m] for m in mid])
    first = list(kept.mapInArrow(centroids._step(start, None), centroids._STATE).collect())
    after = start + 1
    drift = centroids.drifts(start, after)
    assert all(t is None or t > d for row in first for t, d in zip(row["tops"], drift))
