"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from storystream.llm import whitening


def close_up_to_sign(v, w):
    return min(np.abs(v - w).max(), np.abs(v + w).max())


@pytest.mark.parametrize("seed", range(6))
def test_spectrum_against_numpy(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 7, 33, 64, 90][seed]
    x = rng.normal(size=(5 * d + 2, d)) * np.linspace(1, 9, d)
    a = np.cov(x.T, bias=True).reshape(d, d)
    values, v = whitening.spectrum(a)
    expected, w = np.linalg.eigh(a)
    assert np.allclose(values, expected[::-1], rtol=1e-12)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-14
    assert max(close_up_to_sign(v[:, i], w[:, -1 - i]) for i in range(d)) < 1e-10


@pytest.mark.parametrize(
    "values", [[0.0] * 5, [2.0] * 4, [-1.0, 0.0, 1.0], [5.0, 5.0, 5.0, 1.0, 1e-13], [3.0, 3.0 - 1e-9, 1.0, 0.0, 0.0], [1e9, 1.0, 1e-9]]
)
def test_spectrum_of_ties_and_zeros(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, v = whitening.spectrum(a)
    top = max(1.0, max(map(abs, values)))
    assert np.abs(found - sorted(values, reverse=True)).max() < 1e-13 * top * len(values)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ v - v * found).max() < 1e-13 * top * len(values)


def test_against_plain_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 40)) * np.linspace(0.5, 2, 40) + 0.3
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0], 1), (903, [math.nan] * 40, 1), (904, [None] + [1.0] * 39, 1), (905, [math.inf] * 40, 1)]
    rows += [(3, x[3].tolist(), 0), (None, x[4].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, deviation int").repartition(5)
    found = whitening.whiten(table).collect()
    used = np.vstack([x, x[3:5]])
    g = np.floor(64 * used).astype(np.int64) + 1_000_000
    n, sums = len(g), g.sum(axis=0)
    values, v = np.linalg.eigh(np.cov(g.T, bias=True))
    values, v = values[::-1], v[:, ::-1]
    assert len(found) == n * 32 and {r.n for r in found} == {n}
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    for c, some in by_component.items():
        w = np.array([r.whitened for r in some if r.vec_id is not None])
        at = np.array([r.vec_id for r in some if r.vec_id is not None])
        expected = (g[at] - sums / n) @ v[:, c - 1] / np.sqrt(values[c - 1])
        assert close_up_to_sign(w, expected) < 1e-8
        assert abs(some[0].explained - values[c - 1] / values.sum()) < 1e-12
    exact = {i: int(((n * g[i].astype(object) - sums) ** 2).sum()) for i in range(400)}
    assert all(r.deviation == exact[r.vec_id] for r in found if r.vec_id is not None)
    assert 0 <= found[0].identity_error < 1e-10 and len({r.identity_error for r in found}) == 1


def test_deviation_beyond_words():
    model = whitening.Whitening(3 * 10**9, [5, 6], np.empty(0), np.empty(0), np.empty((2, 0)), None)
    x = np.array([[0, 0], [2, 1], [10**3, 0]])
    n = 3 * 10**9
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, [5, 6])) for row in x]
    assert model.deviation(x) == [e if e < 2**63 else None for e in exact]


def test_many_tasks_are_added_in_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    x = np.random.default_rng(5).normal(size=(60, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    model = whitening.fit(table.repartition(11))
    g = np.floor(64 * x)
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(g.T, bias=True))[::-1], rtol=1e-12)


def test_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None),
    ]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened and round(abs(r.whitened), 9)) for r in flat) == [
        (1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None),
    ]
