"""Assignment by rounds: in one task and as jobs, and what it costs."""

from datetime import datetime, timedelta

import numpy as np

from mosaiq.operators import cluster
from mosaiq.params import Params
from tests.engine.test_ordered import sample

NOW = datetime(2024, 1, 2, 12)


def given(spark, n, seed):
    x, old = sample(seed, n, 0.5), sample(seed, 3, 0.5, copies=False) * [[1.0], [4.0], [2.5]]
    loose = spark.createDataFrame([(i, NOW + timedelta(minutes=i * 7 % 20), x[i].tolist()) for i in range(n)], "id long, published_at timestamp, embedding array<double>")
    sums = spark.createDataFrame([(5 + i, old[i].tolist(), 3) for i in range(3)], "cluster_id long, vec_sum array<double>, n long")
    return loose, sums


def test_one_task_and_jobs_agree(spark, monkeypatch):
    loose, sums = given(spark, 60, 2)
    found = [sorted(map(tuple, cluster._rounds(loose, sums, Params(), cap).collect()), key=str) for cap in (1000, 40, 0)]
    assert len(found[0]) > 30 and {c for _, c, f in found[0] if f is None} and {f for _, _, f in found[0] if f is not None}
    assert found[0] == found[1] == found[2]
    monkeypatch.setattr(cluster, "BROADCAST", 0)  # clusters that meet articles in blocks
    assert sorted(map(tuple, cluster._rounds(loose, sums, Params(), 40).collect()), key=str) == found[0]


def test_rounds_of_few_articles_take_few_jobs(spark):
    loose, sums = given(spark, 60, 3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "")
    assert cluster._rounds(loose, sums, Params()).count()
    jobs = len(tracker.getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20


def test_nothing_by_rounds(spark):
    loose, sums = given(spark, 60, 2)
    assert cluster._rounds(loose.limit(0), sums.limit(0), Params()).count() == 0
    assert cluster._rounds(loose.limit(0), sums, Params(), 0).count() == 0
    assert cluster._rounds(loose.limit(1), sums.limit(0), Params(), 0).count() == 0


def test_identical_articles_pair_with_the_least_id():
    x = np.array([[1.0, 0.0]] * 3)
    article, name, new = cluster.by_rounds(np.array([7, 5, 9]), np.ones(3, bool), np.arange(3), np.ones(3, bool), np.array([1, 1, 0]), x, 0.75)
    assert sorted(article.tolist()) == [5, 7, 9] and set(name.tolist()) == {5} and new.all()
