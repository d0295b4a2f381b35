import random
from collections import Counter

import numpy as np
import pytest

from mosaiq.llm import ngram_join


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts, n, num, den):
    sets = [shingles(t, n) for _, t in texts]
    parent = {d: d for d, _ in texts if d is not None}
    links = set()  # (document, its set, document): repeated rows count once

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(texts):
        for j, (b, _) in enumerate(texts):
            if i != j and a is not None and b is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
                    if a != b or sets[i] != sets[j]:
                        links.add((a, sets[i], b, sets[j]))
    many = Counter(a for a, *_ in links)
    return Counter((d, len(s), None if d is None else find(d), many[d]) for (d, _), s in zip(texts, sets, strict=True))


def counted(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_odd_rows(odd, odd_texts, n, num):
    assert counted(ngram_join.components(odd, n, num, 100)) == brute(odd_texts, n, num, 100)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [300, 40])
def test_families_and_blocks(spark, monkeypatch, block):
    """Near copies at all distances, with shared passages, in blocks that meet pairwise."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for _ in range(12) for t in family(rng, 8, rng.randrange(5, 90), 4)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert counted(ngram_join.components(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_large_batches(spark):
    """More rows a batch than a place has numbers."""
    rows = [(i, f"a b c d word{i % 100_000} e f") for i in range(70_000)] + [(100_000 + i, f"some words number{i} that stand in two texts") for i in range(100)]
    rows += [(200_000 + i, f"some words number{i} that stand in two texts") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        found = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.components(docs).filter("doc_id >= 100000").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {k * 100_000 + i: (100_000 + i, 1) for k in (1, 2) for i in range(100)}


def test_links_merge_and_probe(monkeypatch):
    rng = random.Random(2)
    for heap in (0, 10**9):
        monkeypatch.setattr(ngram_join, "HEAP", heap)
        for case in range(60):
            sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 25))), np.int64) for _ in range(25)]
            weights = np.array([rng.randrange(1, 5) for _ in sets])
            side = np.array([rng.randrange(2) for _ in sets]) if case % 2 else None
            found, linked = ngram_join.links(np.array([len(s) for s in sets]), sets, weights, 60, 100, side)
            alike = lambda i, j: (side is None or side[i] != side[j]) and 160 * len(set(sets[i]) & set(sets[j])) >= 60 * (len(sets[i]) + len(sets[j]))  # noqa: E731, B023
            forest = ngram_join.Forest(25)
            for i, j in found:
                assert alike(i, j) and forest.union(i, j)
            for i in range(25):
                near = [j for j in range(25) if j != i and alike(i, j)]
                assert linked[i] == weights[near].sum() and all(forest.find(i) == forest.find(j) for j in near)


def test_representatives_and_empty(odd, none, clash):
    kept = ngram_join.representatives(clash)
    assert kept.columns == clash.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2
    # of rows of one id one stays
    twice = odd.select("doc_id", "text").filter("doc_id = 20")
    assert ngram_join.representatives(twice.unionByName(twice).unionByName(twice.selectExpr("doc_id", "'other words' AS text"))).count() == 1
    assert ngram_join.components(none).count() == 0 and ngram_join.representatives(none).count() == 0
