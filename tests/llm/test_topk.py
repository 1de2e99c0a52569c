"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from tracewell.llm import topk


def brute(rows, k, scale=1024):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in {i: (i, v) for i, v in fine if i % 100 == 0}.values():
        scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in fine if i != q and len(v) == len(w))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 5] + rng.normal(size=16) * 0.3)]) for i in range(620)]
    rows += [(i, rows[7][1]) for i in range(700, 720)]  # ties
    rows += [(800, [0.0] * 16), (900, [float(x) for x in -np.abs(rng.normal(size=16))]), (901, None), (902, []), (903, [1.0] * 15 + [None]), (904, [1.0] * 15 + [float("nan")]), (None, [1.0] * 16), (905, [float("inf")] * 16), (1000, [1.0, 2.0]), (1001, [3.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS vb", "3 AS query_id")
    got = topk.exact_top_k(data, data.where("vec_id % 100 = 0"), 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    assert topk.exact_top_k(data.limit(0), data.limit(0)).count() == 0


def test_one_id_with_two_vectors_and_large_components(spark):
    data = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_top_k(data, data.where("vec_id = 100"), 2, scale=1).collect())
    assert got == sorted([(100, 1, 1, 2), (100, 2, 2, 1), (100, 1, 2, 3), (100, 2, 1, 1)])
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(data.selectExpr("vec_id", "array(1e15, embedding[0]) AS embedding"), data.where("vec_id = 100")).collect()


def test_vectors_far_beyond_the_others(spark):
    """Scores up to 62 bits, of vectors and of queries, are exact; one outlier ends nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 3)]) for i in range(300)]
    rows += [(400, [3e5] + [1.0] * 7), (401, [-3e5] * 8), (402, [1e6, -1e6] + [0.0] * 6), (500, [2e5] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(data, data.where("vec_id % 100 = 0"), 10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    with pytest.raises(TypeError, match="integer"):
        topk.exact_top_k(data.selectExpr("cast(vec_id as string) AS vec_id", "embedding"), data)


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * rng.normal(size=(500, 32))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(500), vectors)
    for q in range(20):
        ids, scores = index.top(vectors[q], q, 10)
        want = sorted((-int(vectors[i] @ vectors[q]), i) for i in range(500) if i != q)[:10]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
