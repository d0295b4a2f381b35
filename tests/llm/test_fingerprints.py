import hashlib
import random

from pyspark.sql import functions as F

from mosaiq.llm import fingerprints as fp
from mosaiq.llm.queries import op3_fingerprints


def likeness(a, b, k=5):
    def s(t):
        w = t.encode().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query(spark, sf):
    rows = {r.doc_id: r for r in op3_fingerprints(spark, sf).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    assert len(rows) == len(docs)
    off = []
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = rows[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(set(zip(*[t.split()[k:] for k in range(5)]))) <= 64 and len(set(zip(*[edited.split()[k:] for k in range(5)]))) <= 64:
            assert abs(r.near_edited - likeness(t, edited)) < 1e-9
        else:
            off += [abs(r.near_edited - likeness(t, edited)), abs(r.near_next - likeness(t, nxt))]
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1.0)
    assert sum(off) / len(off) < 0.04
    by_text = {}
    for d, t in docs:
        assert by_text.setdefault(t, rows[d].fingerprint) == rows[d].fingerprint


def test_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5003).alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = fp.with_next(rows, "doc_id", "text", ["text"], per_range=100).collect()
    order = sorted(((r.doc_id, r.text) for r in out), reverse=True)
    nxt = {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert len(out) == 5000 and all(r.next_text == nxt[r.doc_id] for r in out)


def test_merge_and_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:200]), " ".join(words[196:]))], "a string, b string, c string")
    a, b, c = (fp.sketch(F.col(x)) for x in "abc")
    r = df.select(fp.containment(b, a).alias("inside"), (fp.merged(b, c) == a).alias("same"), fp.likeness(a, b).alias("near")).first()
    assert r.inside == 1.0 and r.same and abs(r.near - 196 / 3996) < 0.03


def test_extracts_and_parts(spark):
    """An extract lies wholly in its text, or nothing can be said; parts always merge to the fingerprint of the whole."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(200):
        at = rng.randrange(2900)
        n = 10 + i // 2
        a, b = sorted((rng.randrange(1, n - 4), rng.randrange(1, n - 4)))
        extract = words[at : at + n]
        rows.append((n, " ".join(words), " ".join(extract), " ".join(extract[: b + 4]), " ".join(extract[a:])))
    df = spark.createDataFrame(rows, "n int, t string, e string, x string, y string")
    t, e, x, y = (fp.sketch(F.col(c)) for c in "texy")
    out = df.select("n", fp.containment(e, t).alias("inside"), (fp.merged(x, y) == e).alias("same"), fp.likeness(e, fp.merged(x, y)).alias("near")).collect()
    assert all(r.inside in (1.0, None) for r in out) and all(r.inside == 1.0 for r in out if r.n >= 40)
    assert sum(r.inside is None for r in out) <= 6
    assert all(r.same and r.near == 1.0 for r in out)


def test_odd_rows(odd, odd_texts, none, clash):
    out = fp.compared(odd).collect()
    assert len(out) == len(odd_texts)
    sizes = {r.text: len(r.sketch.hashes) for r in out}
    assert sizes[""] == 0 and sizes["one"] == 1
    order = sorted(((-1 if d is None else d, t or "") for d, t in odd_texts), key=lambda x: (-x[0], x[1]))
    found = {(-1 if r.doc_id is None else r.doc_id, r.text): r.next_text for r in out}
    for i, x in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        assert found[x] == nxt[1] or order.count(x) > 1
    assert fp.compared(none).count() == 0 and fp.compared(clash).count() == len(odd_texts)
