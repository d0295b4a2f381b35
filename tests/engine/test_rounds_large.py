"""Rounds beyond one task: few jobs, every way of finding births, and memory without a table of all links."""

import tracemalloc

import numpy as np
import pytest

from mosaiq.operators import cluster
from mosaiq.params import Params
from tests.engine.test_ordered import sample
from tests.engine.test_rounds import given


def rows(found):
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize(("early", "unresolved", "snapshots"), [(4, 4096, 256), (1, 4096, 0), (4, 0, 256)])
def test_births_by_few_early_articles_or_by_pairs(spark, monkeypatch, early, unresolved, snapshots):
    loose, sums = given(spark, 90, 4)
    loose = loose.repartition(3)
    wanted = rows(cluster._rounds(loose, sums, Params()))
    assert len(wanted) > 40 and len({f for _, _, f in wanted}) > 3
    for name, value in (("EARLY", early), ("UNRESOLVED", unresolved), ("SNAPSHOTS", snapshots)):
        monkeypatch.setattr(cluster, name, value)
    assert rows(cluster._rounds(loose, sums, Params(), 0)) == wanted


def test_a_step_is_one_job(spark):
    loose, sums = given(spark, 60, 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("steps", "")
    assert cluster._rounds(loose, sums, Params(), 0).count()
    jobs = len(tracker.getJobIdsForGroup("steps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60


def test_links_take_no_square_of_memory(monkeypatch):
    monkeypatch.setattr(cluster, "PRODUCTS", 1 << 18)
    n = 5000
    x = sample(7, n, 0.6)
    tracemalloc.start()
    article, name, new = cluster.by_rounds(np.arange(n), np.ones(n, bool), np.arange(n), np.ones(n, bool), np.arange(n) % 50, x, 0.75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(article) > n // 2 and new.all() and peak < n * n


def test_an_article_without_neighbours_still_joins_a_cluster():
    a = np.deg2rad([0.0, 40.0, 20.0])  # the third is only near the centroid of the others
    x = np.stack([np.cos(a), np.sin(a), np.zeros(3)], 1)
    x[2] = x[2] * 0.77 + [0, 0, (1 - 0.77**2) ** 0.5]
    article, name, _ = cluster.by_rounds(np.arange(3), np.ones(3, bool), np.arange(3), np.ones(3, bool), np.arange(3), x, 0.75)
    assert sorted(article.tolist()) == [0, 1, 2] and set(name.tolist()) == {1}
