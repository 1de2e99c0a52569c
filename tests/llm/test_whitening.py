"""Whitening against a dense solution."""

import math

import numpy as np
import pytest

from tracewell.llm import whitening


def rows_of(spark, rows, **more):
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS n", "3 AS y", "4 AS at")
    return [tuple(r) for r in whitening.whitened_rows(data, **more).collect()]


def dense(rows, scale=64, offset=1_000_000):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(scale * c) + offset for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = ((x * n - sums) / n).astype(float)
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    return kept, n, deviation, y, e, axes


def test_against_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 40)) * np.linspace(0.2, 4, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + rng.normal(size=40) * 50
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (400, None), (401, []), (402, [1.0] * 39 + [None]), (403, [float("nan")] * 40), (404, [float("inf")] * 40)]
    got = rows_of(spark, rows)
    kept, n, deviation, y, e, axes = dense(rows)
    assert n == 302 and len(got) == n * 32 and {r[1] for r in got} == set(range(1, 33)) and {r[2] for r in got} == {n}
    assert sorted((r[0] is None, r[0] or 0, int(r[3])) for r in got if r[1] == 1) == sorted((i is None, i or 0, d) for (i, _), d in zip(kept, deviation))
    w = y @ axes / np.sqrt(e)
    for component in range(1, 33):
        own = sorted((r[0] is None, r[0] or 0, r[4]) for r in got if r[1] == component)
        want = [x for *_, x in sorted(((i is None), i or 0, x) for (i, _), x in zip(kept, w[:, component - 1]))]
        a, b = np.array([x for *_, x in own]), np.array(want)
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert [r[5] for r in got if r[1] == component] == pytest.approx([e[component - 1] / (sum(deviation) / n**3)] * n, rel=1e-9)
    assert {r[6] for r in got if r[6] > 1e-9} == set()


def test_rank_lengths_and_empty_tables(spark):
    flat = [(i, [float(i % 3), float(i % 3), 5.0]) for i in range(9)]  # one direction only
    got = rows_of(spark, flat)
    assert {r[1] for r in got} == {1} and len(got) == 9 and all(r[5] == pytest.approx(1) and r[6] < 1e-9 for r in got)
    assert rows_of(spark, [(1, [2.0, 3.0])] * 3) == []  # no variance at all
    mixed = rows_of(spark, flat + [(20, [1.0]), (21, [3.0])])
    assert sorted((r[0], r[2], int(r[3])) for r in mixed if r[0] >= 20) == [(20, 2, 128**2), (21, 2, 128**2)] and {r[2] for r in mixed if r[0] < 20} == {9}
    assert rows_of(spark, []) == [] and rows_of(spark, [(1, None)]) == []


def test_a_large_offset_costs_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    near, far = (sorted(r[:2] + (abs(round(r[4], 9)),) for r in rows_of(spark, rows, offset=o)) for o in (0, 1 << 40))
    assert near == far
    deviation = {int(r[3]) for r in rows_of(spark, rows, offset=1 << 40)}
    assert deviation == set(dense(rows, offset=0)[2])


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float((-1) ** i * 2.0**40), float(i)]) for i in range(10)]
    got = {r[0]: int(r[3]) for r in rows_of(spark, rows, scale=64)}
    kept, _, deviation, *_ = dense(rows)
    assert got == {i: d for (i, _), d in zip(kept, deviation)} and max(deviation) > 1 << 63
