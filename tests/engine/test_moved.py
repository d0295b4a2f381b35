"""What operators move between tasks: texts only of the articles that they need."""

import re

from pyspark.sql import functions as F

from mosaiq.operators import evidence, vectorise


def test_a_limited_run_chooses_by_ids(spark):
    schema = "article_id long, title string, body string, page long"
    articles = spark.createDataFrame([(i, "t", "b" * 50, i % 3) for i in range(20)], schema).repartition(3)
    pages = spark.createDataFrame([(i,) for i in range(3)], "page long")
    vectors = spark.createDataFrame([(i, [1.0] if i % 4 else None) for i in range(0, 20, 2)], "article_id long, embedding array<double>")
    joined = articles.join(pages.hint("merge"), "page")
    found = vectorise.pending(joined, vectors.hint("merge"), 5)
    assert [r.article_id for r in found.collect()] == [0, 1, 3, 4, 5]
    assert "body" in found.columns and vectorise.pending(articles, vectors, 0).count() == 0
    # what goes into the join with pages has been chosen before
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in tree and re.search(r"article_id#\d+L? IN \(", tree[tree.index("Join") :])


def test_long_limits_choose_the_same(spark, monkeypatch):
    articles = spark.createDataFrame([(i, "t") for i in range(20)], "article_id long, title string")
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(0, 20, 2)], "article_id long, embedding array<double>")
    for listed, broadcast in ((1000, 1 << 20), (0, 1 << 20), (0, 0)):
        monkeypatch.setattr(vectorise, "LISTED", listed)
        monkeypatch.setattr(vectorise, "BROADCAST", broadcast)
        assert [r.article_id for r in vectorise.pending(articles, vectors, 4).collect()] == [1, 3, 5, 7]


def test_the_vocabulary_of_some_terms(spark):
    texts = [(i, f"casa rey {'mil' if i < 5 else 'uno'} w{i}") for i in range(30)]
    docs = spark.createDataFrame(texts, "id long, text string")
    whole = {r.term: r for r in evidence.fit_vocabulary(docs, "id").collect()}
    some = spark.createDataFrame([("mil",), ("casa",), ("w3",), ("none",)], "term string")
    found = {r.term: r for r in evidence.fit_vocabulary(docs, "id", only=some).collect()}
    assert found == {k: v for k, v in whole.items() if k in ("mil", "casa", "w3", "none")} and set(found) == {"mil"}


def test_evidence_takes_texts_apart(spark):
    members = spark.createDataFrame([(c, c * 10 + i, i % 3, f"t{i}", f"casa rey Ana Mar{i} mil") for c in range(2) for i in range(10)], "cluster_id long, article_id long, outlet_id int, title string, body string")
    vectors = spark.createDataFrame([(c * 10 + i, [1.0, float(i)]) for c in range(2) for i in range(10)], "article_id long, embedding array<double>")
    outlets = spark.createDataFrame([(i, f"o{i}") for i in range(3)], "outlet_id int, name string")
    docs = members.select("article_id", F.col("body").alias("text"))
    whole = evidence.evidence(members, vectors, outlets, evidence.fit_vocabulary(docs, "article_id"))
    apart = evidence.evidence(members.select("cluster_id", "article_id", "outlet_id"), vectors, outlets, lambda terms: evidence.fit_vocabulary(docs, "article_id", only=terms), articles=members)
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect())) and whole.count() == 2
