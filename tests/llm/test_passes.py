"""Sorted projection passes: recall against all pairs, and repeated ids."""

import numpy as np
import pytest

from storystream.llm import vectors


def planted(n, mutual, seed):
    """`n` vectors at a mutual cosine, of which every tenth has a partner at about 0.931, and a dense group of 400."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(64)
    x = np.sqrt(mutual) * centre / np.linalg.norm(centre) + np.sqrt((1 - mutual) / 64) * rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = n // 10
    other = rng.standard_normal((k, 64))
    other -= (other * x[:k]).sum(axis=1, keepdims=True) * x[:k]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x[k : 2 * k] = 0.932 * x[:k] + np.sqrt(1 - 0.932**2) * other
    x[2 * k : 2 * k + 400] = x[2 * k] + 0.01 * rng.standard_normal((400, 64))
    return x


def true_links(x):
    links, pairs = np.zeros(len(x), int), []
    for start in range(0, len(x), 1000):
        hits = x[start : start + 1000] @ x.T >= vectors.COSINE
        hits[np.arange(len(hits)), np.arange(start, start + len(hits))] = False
        links[start : start + 1000] = hits.sum(axis=1)
        i, j = np.nonzero(hits)
        pairs += list(zip(i + start, j))
    return links, pairs


@pytest.mark.parametrize(("n", "mutual"), [(10_000, 0.0), (10_000, 0.6), (30_000, 0.6)])
def test_recall_of_passes(spark, n, mutual):
    x = planted(n, mutual, 7)
    assert vectors.passes_needed(n, mutual, vectors.COSINE, 64, vectors.MISS)
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: r for r in vectors.near_vectors(table.repartition(8), window=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, pairs = true_links(unit)
    got = np.array([found[i].n_links for i in range(n)])
    assert (got <= links).all()
    assert got.sum() >= 0.99 * links.sum()
    together = [found[i].component_id == found[j].component_id for i, j in pairs if i < n // 5]
    assert np.mean(together) >= 0.98
    # The dense group is wider than a window and still has all its links
    k = n // 10
    assert (got[2 * k : 2 * k + 400] == links[2 * k : 2 * k + 400]).all()


def test_passes_follow_size_and_direction():
    needed = lambda n, m: vectors.passes_needed(n, m, 0.93, 256, 0.005)
    assert needed(500, 0) is None and needed(10**6, 0.95) is None
    assert needed(10_000, 0) < needed(1_000_000, 0) < needed(1_000_000, 0.6)


def test_vectors_of_one_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.01, 1.0], 1), (3, [1.0, 0.01], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
