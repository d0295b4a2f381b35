"""Links of several thresholds from one set of products."""

import numpy as np

from mosaiq.operators import reports, similarity
from mosaiq.operators.components import connected_components


def test_each_threshold_has_its_components(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id long, embedding array<double>")
    every = similarity.linked_above_each(vectors, (0.7, 0.8, 0.9), block=25)
    for at, threshold in enumerate((0.7, 0.8, 0.9)):
        wanted = set(map(tuple, connected_components(similarity.linked_above(vectors, threshold, block=25)).collect()))
        assert wanted and set(map(tuple, connected_components(every.filter(f"threshold = {at}")).collect())) == wanted
    # the sweep multiplies once
    calls = []
    given = similarity._block_pairs
    monkeypatch.setattr(similarity, "_block_pairs", lambda *a: calls.append(a) or given(*a))
    articles = spark.createDataFrame([(i, i % 3) for i in range(90)], "article_id long, outlet_id int")
    found = reports.threshold_sweep(vectors.withColumnRenamed("id", "article_id"), articles, (0.7, 0.8, 0.9)).collect()
    assert len(calls) == 1 and len(found) == 3


def test_a_million_vectors_make_few_blocks():
    assert -(-615_360 // similarity._block_size(615_360, similarity.BLOCK)) <= 16
    assert -(-1_000_000 // similarity._block_size(1_000_000, similarity.BLOCK)) <= 16
