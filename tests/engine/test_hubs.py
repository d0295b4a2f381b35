"""Components by hubs against blocks, and windows that look for few partners against one loop."""

from datetime import timedelta

import numpy as np
import pytest

from mosaiq.operators import cluster, components, ordered, similarity
from mosaiq.params import Params
from tests.engine.test_ordered import NOW, groups
from tests.engine.test_ordered import sample as ordered_sample
from tests.engine.test_similarity import KINDS, frame, sample


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.1])
def test_components_by_hubs(spark, kind, threshold):
    x = sample(kind)
    df = frame(spark, x, -40)  # forty clusters
    for mixed in (None, 0.8):
        wanted = {(r.node, r.component) for r in components.connected_components(similarity.linked_above(df, threshold, mixed, block=16)).collect()}
        found = similarity.components_above(df, threshold, mixed, block=16, hubs=8, apart=300).collect()
        assert {(r.node, r.component) for r in found} == wanted and len(found) == len(wanted)


def test_dense_links_make_no_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * 0.5 + 1
    df = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    monkeypatch.setattr(similarity, "_block_pairs", None)  # would compute all products
    found = similarity.components_above(df, 0.6, hubs=16, apart=50).collect()
    assert {r.component for r in found} == {0} and len(found) == 300


@pytest.mark.parametrize(("seed", "asked", "far"), [(1, 3, 0.15), (2, 6, 0.0), (4, 2, 0.4)])
def test_windows_that_look_for_few_partners_are_sequential(spark, monkeypatch, seed, asked, far):
    monkeypatch.setattr(ordered, "FAR", far)
    looked, partners = [], ordered._partners
    monkeypatch.setattr(ordered, "_partners", lambda free, ids, x, *a: looked.append((len(ids), len(x))) or partners(free, ids, x, *a))
    n = 60
    x = ordered_sample(seed, n, 0.3)
    loose = spark.createDataFrame([(i, NOW + timedelta(minutes=i * 7 % 20), x[i].tolist()) for i in range(n)], "id long, published_at timestamp, embedding array<double>")
    sums = spark.createDataFrame([], "cluster_id long, vec_sum array<double>, n long")
    found = ordered.assign_in_order(loose, sums, Params(), 20, 2, asked).collect()
    order = sorted(range(n), key=lambda i: (i * 7 % 20, i))
    wanted = cluster.sequential(np.array(order), x[order], np.zeros(0, np.int64), np.zeros((0, 12)), 0.75)
    assert groups([(r.article_id, r.founder) for r in found]) == groups([(a, f) for a, _, f in wanted])
    assert len(wanted) > 30 and max(m for _, m in looked) <= asked and any(k > m for k, m in looked)
