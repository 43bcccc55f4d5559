"""Whitening against numpy's own decomposition and exact integers."""

import math

import numpy as np
import pytest

from roadpulse.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, vector string, at int, whitened double, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5, None) for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    y = np.array(x) - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return [i for i, _ in kept], deviation, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def vectors(n, dims, seed=3):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dims)) * np.linspace(0.4, 0.1, dims)).tolist()


@pytest.mark.parametrize("dims", [1, 3, 12])
def test_rows_equal_brute_force(spark, dims):
    rows = list(enumerate(vectors(300, dims))) + [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (None, [0.1] * dims), (7, [0.1] * dims), (905, [0.5] * (dims + 1))]
    got = w.whitened_rows(table(spark, rows)).collect()
    ids, deviation, white, explained = brute(rows[:-1])
    k = min(dims, 8)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)} and {r["component"] for r in got} == set(range(1, k + 1))
    expected = {}
    for i, d, row in zip(ids, deviation, white):
        expected.setdefault(i, []).append((d, row))
    signs = {}
    for r in got:
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
        match = [row[c] for d, row in expected[r["vec_id"]] if d == r["deviation"]]
        assert match
        if abs(match[0]) > 1e-3 and len(match) == 1:
            signs.setdefault(c, set()).add(round(r["whitened"] / match[0]))
            assert abs(r["whitened"]) == pytest.approx(abs(match[0]), rel=1e-9)
    assert all(len(s) == 1 for s in signs.values())


def test_degenerate_tables(spark):
    assert w.whitened_rows(table(spark, [])).count() == 0
    assert w.whitened_rows(table(spark, [(1, None), (2, [])])).count() == 0
    assert w.whitened_rows(table(spark, [(1, [0.5, 0.25])])).count() == 0  # nothing varies
    assert w.whitened_rows(table(spark, [(k, [0.5, 0.25]) for k in range(5)])).count() == 0
    flat = w.whitened_rows(table(spark, [(k, [k / 64, 0.25, 0.5 - k / 32]) for k in range(20)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 20  # one direction varies
    huge = w.whitened_rows(table(spark, [(k, [1e30 * k, -3e7 * k]) for k in range(4)])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 0} == {None}
    wide = w.whitened_rows(table(spark, [(k, [2e6 * k, 1.0]) for k in range(2)])).collect()
    assert [r["deviation"] for r in wide] == [2048000000**2] * 2  # beyond the fast path, still exact


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 1.0, 1.0], [9.0, 8.0, 7.0, 0.0, 0.0], [1e6, 1.0, 1e-3, 1e-3, 1e-9], [3.0, 3.0 + 1e-12, 3.0 - 1e-12, 2.0, 1.0], list(range(40))])
def test_divide_and_conquer(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found = w.components(a, len(values))
    e, v = np.array([x for x, _ in found]), np.array([x for _, x in found]).T
    scale = max(values)
    assert np.allclose(e, sorted(values, reverse=True), rtol=0, atol=1e-11 * scale)
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ v, v * e, atol=1e-11 * scale)
    few = w.components(a, 2)
    assert np.allclose([x for x, _ in few], e[:2], atol=1e-11 * scale)


def test_polar_factor():
    r = np.random.default_rng(2).standard_normal((30, 30))
    a = r + r.T
    u = w.polar(a)
    s, v = np.linalg.eigh(a)
    assert np.allclose(u, v @ np.diag(np.sign(s)) @ v.T, atol=1e-12)
