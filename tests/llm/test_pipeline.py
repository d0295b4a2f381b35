"""The pipeline's stages against plain versions, and its packing against its input."""

import corpus_pipeline
from test_packing import verify

from mosaiq.llm import quality
from mosaiq.tables import written


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    first = written(corpus_pipeline.STAGES[0][1](spark, docs, sf), "t1")
    kept = {r.doc_id: r for r in first.collect()}
    assert first.columns == columns
    judged = {d: quality.measure(t) for d, t in texts.items()}
    assert {d: m[8] for d, m in judged.items() if m[7]} == {d: r.text for d, r in kept.items()}
    assert all(r.n_chars == len(r.text) for r in kept.values())

    second = written(corpus_pipeline.STAGES[1][1](spark, first, sf), "t2")
    sets = {d: shingles(r.text) for d, r in kept.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert second.columns == columns
    assert {r.doc_id for r in second.collect()} == {d for d in sets if find(d) == d}

    third = written(corpus_pipeline.STAGES[2][1](spark, second, sf), "t3")
    assert third.columns == columns and third.count() == second.count()
    assert third.filter("text rlike '[0-9a-f]{32}'").count() == 0

    rows = corpus_pipeline.STAGES[3][1](spark, third, sf).collect()
    assert verify(rows, [(r.doc_id, r.text) for r in third.collect()]) < 0.03
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(rows)
