"""Assignment by windows against one loop over all articles."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from mosaiq.operators import cluster, ordered
from mosaiq.params import Params

NOW = datetime(2024, 1, 2, 12)


def sample(seed, n, noise, d=12, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    x = np.array([centres[rng.integers(5)] + rng.normal(size=d) * noise for _ in range(n)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if copies:
        x[n // 2] = x[n // 3] = x[1]
    return x


def groups(pairs):
    """The new clusters as sorted lists, the old ones by name."""
    names = {k for _, k in pairs}
    return sorted((k if k < 0 else 0, sorted(a for a, b in pairs if b == k)) for k in names)


@pytest.mark.parametrize(("seed", "noise", "window", "k"), [(1, 0.35, 16, 1), (2, 0.5, 7, 2), (3, 0.2, 1000, 4)])
def test_windows_are_sequential(spark, seed, noise, window, k):
    n = 60
    x = sample(seed, n, noise)
    stamps = [NOW + timedelta(minutes=int(m)) for m in np.random.default_rng(seed).integers(0, 20, n)]
    old = sample(seed, 3, noise, copies=False) * [[1.0], [4.0], [2.5]]
    loose = spark.createDataFrame([(i, stamps[i], x[i].tolist()) for i in range(n)], "id long, published_at timestamp, embedding array<double>").repartition(3)
    sums = spark.createDataFrame([(5 + i, old[i].tolist(), 3) for i in range(3)], "cluster_id long, vec_sum array<double>, n long")
    found = ordered.assign_in_order(loose, sums, Params(), window, k).collect()
    order = sorted(range(n), key=lambda i: (stamps[i], i))
    wanted = cluster.sequential(np.array(order), x[order], np.array([5, 6, 7]), old, 0.75)
    assert len(wanted) > 30
    key = lambda c, f: -1 - c if c is not None else f
    assert groups([(r.article_id, key(r.cluster_id, r.founder)) for r in found]) == groups([(a, key(c, f)) for a, c, f in wanted])


def test_nothing_to_assign(spark):
    loose = spark.createDataFrame([], "id long, published_at timestamp, embedding array<double>")
    sums = spark.createDataFrame([], "cluster_id long, vec_sum array<double>, n long")
    assert ordered.assign_in_order(loose, sums).count() == 0
    one = spark.createDataFrame([(1, NOW, [1.0, 0.0])], loose.schema)
    assert ordered.assign_in_order(one, sums).count() == 0


def test_a_window_ends_where_its_list_of_partners_does():
    # two loose articles outside; the third of the window finds its only listed partner gone
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    far = {0: [(1.0, 9, 90, np.array([1.0, 0.0]))], 1: [], 2: [(1.0, 9, 90, np.array([1.0, 0.0]))]}
    placed, changed, done = ordered.replay(np.array([1, 2, 3]), np.array([1, 2, 3]), x, [], {0: far[0]}, 1, 0.75, 1)
    assert done == 3 and placed[:2] == [(3, 3, True), (1, 3, True)]  # inside first, by time
    x[2] = [0.0, -1.0]
    placed, _, done = ordered.replay(np.array([1, 2, 3]), np.array([1, 2, 3]), x, [], {0: far[0], 2: far[0]}, 1, 0.75, 1)
    assert done == 2 and placed == [(90, 90, True), (1, 90, True)]


def test_partners_beyond_a_bound_are_not_sorted(spark, monkeypatch):
    # many loose articles near each of the window: after the first chunks only better ones are looked at
    x = sample(5, 3000, 0.4, d=8)
    rows = spark.createDataFrame([(i, i % 7, x[i].tolist()) for i in range(3000)], "id long, stamp long, vector array<double>").coalesce(1)
    found = ordered._partners(rows, np.arange(40), x[:40], 0.3, 4).collect()
    sims = np.round(x[:40] @ x.T, 12)
    for i in range(40):
        wanted = sorted((-sims[i, j], j % 7, j) for j in range(40, 3000) if sims[i, j] >= 0.3)[:4]
        assert [r[2] for r in sorted((-r.sim, r.stamp, r.key) for r in found if r.near == i)] == [j for _, _, j in wanted]
