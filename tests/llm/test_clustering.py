"""Exact k-means against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from tracewell.llm import clustering


def plain(rows, k=8, rounds=10, dims=64, scale=1024):
    """Lloyd's rounds as the contract states them."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, j, d in out if j == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inertia[j], sum(inertia), digest[j]) for i, j, d in out)


def found(spark, rows, report=None, **more):
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS distance")
    return sorted(tuple(r) for r in clustering.k_means(data, report=report, **more).collect())


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=64) * 0.4)]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [rows[5], rows[5]]  # copies, repeated rows
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [1.0] * 63 + [float("nan")]), (906, [float("-inf")] * 64), (None, [0.5] * 64), (907, [-0.0] * 64)]
    rows += [(950, [3e5, *[0.0] * 63]), (951, [-3e5] * 64)]  # far beyond the others
    report = []
    assert found(spark, rows, report) == plain(rows)
    assert {n for n, _ in report} == {465}
    assert report[0][1] == 465 and sum(s for _, s in report[1:]) < 0.7 * 10 * 465  # bounds spare scans


def test_ties_and_few_vectors(spark):
    small = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert found(spark, small) == plain(small)  # seeds that are equal: the later ones stay empty
    assert found(spark, small[:1]) == plain(small[:1])
    between = [(i, [float(x)] + [0.0] * 63) for i, x in enumerate((0, 1, 2, 3, 4, 2, 2, 6, 8, 1))]
    assert found(spark, between, k=3, scale=1) == plain(between, k=3, scale=1)
    assert found(spark, []) == [] and found(spark, [(1, None), (None, [1.0] * 64)]) == []


def test_distances_beyond_64_bits(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(1, [1e7] * 64), (2, [-1e7] * 64), (3, [0.0] * 64)], k=1)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(1, [1e300] * 64)])


def test_bounds_hold_after_any_move():
    """Whatever the drift, what the bounds leave alone is where a full scan would put it."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2000, 2000, (300, 64))
    c = [list(map(int, x)) for x in rng.integers(-500, 500, (8, 64))]
    state = clustering.Step(c, c).assign(v, np.full(300, -1, np.int32), np.zeros(300), np.zeros(300), False)
    for size in (1, 30, 300):
        moved = [[x + int(rng.integers(-size, size + 1)) for x in row] for row in c]
        state = clustering.Step(moved, c).assign(v, state[0], state[1], state[2], False)
        full = clustering.squared(v, moved)
        assert (state[0] == full.argmin(axis=1)).all()
        own = np.sqrt(full[np.arange(300), state[0]].astype(float))
        others = np.sqrt(np.sort(full, axis=1)[:, 1].astype(float))
        assert (own <= state[1] * (1 + 1e-12)).all() and (state[2] <= others * (1 + 1e-12)).all()
        c = moved
