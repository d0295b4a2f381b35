"""Terms stay in the part where their document is cut: what comes back is what the vocabulary says of them."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mosaiq import queries
from mosaiq.operators import evidence


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_known_counts_are_the_vocabulary_on_the_counts(spark, parts):
    texts = [(i, f"casa rey {'mil' if i < 5 else 'uno'} uno w{i} w{i // 3}") for i in range(30)]
    texts += [(None, "mil casa"), (40, None), (41, ""), (42, "x"), (3, "mil mil rey"), (43, "mil")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(4)
    counts = evidence.term_counts(docs, ["id"], whole=True)
    vocabulary = evidence.vocabulary_of(counts, docs.select(F.count("*").alias("n_docs")))
    known = evidence.known_counts(docs, ["id"], parts)
    found = {(r.id, r.term): (r.tf, r.idf) for r in known.collect()}
    assert found == {(r.id, r.term): (r.tf, r.idf) for r in counts.join(vocabulary, "term").collect()}
    assert found[3, "mil"][0] == 3 and (None, "mil") in found and (0, "casa") not in found and known.count() == len(found)
    weights = {(r.id, r.term): r.weight for r in evidence.unit_weights(known, ["_part", "id"]).collect()}
    length = defaultdict(float)
    for (i, _), (tf, idf) in found.items():
        length[i] += ((1 + math.log(tf)) * idf) ** 2
    assert weights == {(i, t): pytest.approx((1 + math.log(tf)) * idf / math.sqrt(length[i])) for (i, t), (tf, idf) in found.items()}


def test_a_small_corpus_keeps_all_terms(spark):
    docs = spark.createDataFrame([(i, f"casa w{i}") for i in range(5)], "id long, text string")
    assert Counter(r.term for r in evidence.known_counts(docs, ["id"], 2).collect())["casa"] == 5
    assert evidence.known_counts(docs.limit(0), ["id"], 2).count() == 0 and evidence.parts_for(docs.limit(0)) >= 1


def test_no_document_is_moved_by_term(spark, sf):
    """Texts go to their parts in one exchange that both readers share, and terms leave and come back once a part."""
    df = queries.queries()["tfidf_weights"](spark, sf)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if re.search(r"Exchange (hash|shuffle)partition", line) and "ReusedExchange" not in line]
    assert sum("direct_shuffle_partition_id" in line for line in moved) == 3 and plan.count("ReusedExchange [article_id") + plan.count("ReusedExchange [_part") == 1
    assert not any("hashpartitioning(" in line and ("term" in line or "article_id" in line) for line in moved)
