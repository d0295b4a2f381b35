"""The factorisation machine against the sum over pairs, and its scores on held-out rows."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from mosaiq.llm import fm, queries


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_identity():
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32)
    rows = [(rng.integers(0, 50, k).astype(np.int32), rng.normal(size=k).astype(np.float32)) for k in (1, 2, 9, 20)]
    starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])[:-1]])
    found = fm.scores(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), starts, 0.5, w, v)
    for (at, x), z in zip(rows, found, strict=True):
        pairs = sum(float(v[at[i]] @ v[at[j]]) * x[i] * x[j] for i, j in combinations(range(len(at)), 2))
        assert z == pytest.approx(0.5 + float(w[at] @ x) + pairs, rel=1e-3, abs=1e-3)


def test_interactions_are_learned():
    # labels that no linear model knows: either feature alone is good, both or none aren't
    model = fm.Model(buckets=8, factors=4, steps=750, batch=16, rate=0.3)
    rows = [(np.array([i for i in (0, 1) if k >> i & 1] + [2], np.int32), None) for k in range(4)]
    rows = [(a, np.ones(len(a), np.float32)) for a, _ in rows] * 20
    label = np.array([0, 1, 1, 0] * 20, np.float32)
    b, w, v = fm.fit(rows, label, model)
    starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows[:4]])[:-1]])
    z = fm.scores(np.concatenate([a for a, _ in rows[:4]]), np.concatenate([x for _, x in rows[:4]]), starts, b, w, v)
    assert (z > 0).tolist() == [False, True, True, False]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op12_quality_classifier(spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in found.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    score, label = np.array([found[r.doc_id].score for r in labels]), np.array([r.quality for r in labels])
    assert auc(score, label) > 0.95
    assert ((score >= 0.3) == label).mean() > 0.93


def test_only_the_text_and_training_labels_matter(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    one = fm.score(docs, fm.train(docs, labels)).collect()
    two = fm.score(docs.repartition(7), fm.train(docs.repartition(3), labels.repartition(2))).collect()
    assert sorted(one) == sorted(two)


def test_odd_rows(spark, odd, none, clash):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 0), (5, 1), (None, 1), (6, None), (999, 1)], "doc_id long, label int")
    trained = fm.train(odd, labels)
    out = fm.score(odd, trained).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert fm.score(none, trained).count() == 0
    assert {r.score for r in fm.score(odd, fm.train(none, labels)).collect()} == {0.5}
    wide = fm.score(clash.withColumn("score", F.lit("x")), fm.train(clash, labels, metadata=["source", "n"]), metadata=["source", "n"])
    assert wide.count() == clash.count() and dict(wide.dtypes)["score"] == "double" and "source" in wide.columns


def test_sample_is_bounded(spark):
    rows = spark.range(500).selectExpr("id % 50 AS doc_id", "'a b c' AS text")
    labels = spark.range(50).selectExpr("id AS doc_id", "1 AS label")
    model = fm.Model(buckets=64, sample=20)
    assert fm.train(rows, labels, model).count() == 1
