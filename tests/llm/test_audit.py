"""The filter audit against filters that are applied one after the other."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from mosaiq.llm import audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Each order applied step by step."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failing = []
    for d, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if d is not None and any((x[1] or "") == t and x[0] is not None and x[0] < d for x in docs) else set()
        failing.append((s or "", bad, d in good, d in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in failing}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                every = [f for f in failing if f[0] == part and x in f[1]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(every) - len(gone), sum(f[1] == {x} for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(rows) == len(out)
    return out


def test_popcounts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 1000):
        words, weights = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32), rng.integers(0, 50, n)
        weights[: n // 5] += 1 << 35
        assert audit.positional_popcounts(words, weights).tolist() == [sum(int(w) for x, w in zip(words, weights, strict=True) if int(x) >> b & 1) for b in range(32)]


def test_words_are_truth_tables(spark):
    from pyspark.sql import functions as F

    for failing in range(32):
        word = spark.range(1).select(audit.survival_word([F.lit(bool(failing >> f & 1)) for f in range(5)]).alias("w")).first()["w"]
        assert [word >> s & 1 for s in range(32)] == [int(s & failing == 0) for s in range(32)]


def test_orders_applied(spark):
    rng = random.Random(4)
    texts = [None, "", "short", "Plain words " + " ".join(f"w{i}" for i in range(60)), "same same " * 40, "SHOUT " + " ".join(f"W{i}A" for i in range(70)), "#tag " + " ".join(f"x{i}" for i in range(55)), "ONE | TWO", "é" * 99 + "A" * 5, "é" * 94 + "A" * 5]
    docs = [(rng.choice([None, *range(300)]), rng.choice(texts) if rng.random() < 0.7 else f"own {i} " + "word " * rng.randrange(70), rng.choice(["a", "b", None, ""])) for i in range(250)]
    docs += docs[:20] + [(5, texts[3], "a"), (5, texts[3], "b"), (5, texts[3], "a")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(audit.audit(frame, marks)) == plain(docs, labels)


def test_copies_are_summed_before_they_meet(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'one text' AS text", "'s' AS source")
    labels = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    words = audit.words_of(docs, labels)
    counted = Counter()
    for r in words.collect():
        counted[r.good, r.word & audit.WITHOUT[4] == r.word] += r.n
    assert counted == {(False, False): 1, (False, True): 4998, (True, True): 1}
    out = found(audit.audit(docs, labels))
    assert out["s", "EABCD", 1][:3] == (1, 4999, 0) and out["s", "ABCDE", 1][:3] == (0, 5000, 0)


def test_empty_and_clashing(spark, none, clash):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(none.withColumn("source", F.lit("x")), labels).count() == 0
    wide = labels.withColumn("text", F.lit("x")).withColumn("word", F.lit(3))
    crowded = clash.withColumn("word", F.lit(1)).withColumn("part", F.lit("p")).withColumn("digest", F.lit("d")).withColumn("good", F.lit("d"))
    assert audit.audit(crowded, wide).count() == 600
    assert found(audit.audit(crowded, labels.limit(0)))["x", "ABCDE", 1][0] + found(audit.audit(crowded, labels.limit(0)))["x", "ABCDE", 1][1] == clash.count()
