import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import backoff

RARE = "<rare>"


def brute(texts, share):
    """doc_id -> (n_tokens, n_known, N, base, score), by dictionaries."""
    tokens = [(d, (t or "").encode().lower().split() + [backoff.END_WORD]) for d, t in texts]
    train = [w for d, w in tokens if backoff.trains(d)]
    u = Counter(x for w in train for x in w)
    n, v = sum(u.values()), len(u)
    frequent = {w for w, c in u.items() if c >= max(1, n * share)}
    group = lambda w: w if w in frequent else RARE
    pairs = lambda w: list(zip(["<s>", *map(group, w)], map(group, w)))
    bi = Counter(p for w in train for p in pairs(w))
    d1, d2 = backoff.discounts(Counter(u.values())), backoff.discounts(Counter(bi.values()))
    cut = lambda c, d: c * d[min(c, backoff.K + 1)]
    mass = sum(cut(c, d1) for c in u.values()) / n
    scale = 1.0 if mass < 1 - 1e-12 else n / (n + 1) / mass
    unseen = 1 - mass * scale
    p1 = lambda w: cut(u[w], d1) * scale / n if w in u else unseen
    p_rare = max(1 - sum(p1(w) for w in frequent), unseen)
    q = lambda g: p_rare if g == RARE else p1(g)
    total, kept, seen = Counter(), defaultdict(float), defaultdict(float)
    for (h, w), c in bi.items():
        total[h] += c
        kept[h] += cut(c, d2)
        seen[h] += q(w)

    def factors(h):
        if h not in total:
            return 1.0, 1.0
        k, rest = kept[h] / total[h], 1 - seen[h]
        s = 1 / k if rest < 1e-12 else (total[h] / (total[h] + 1) / k if k > 1 - 1e-12 else 1.0)
        return s, 0.0 if rest < 1e-12 else (1 - s * k) / rest

    def p2(h, w):
        s, a = factors(h)
        return s * cut(bi[h, w], d2) / total[h] if (h, w) in bi else a * q(w)

    for h in [*total, "never"]:  # exactly normalised
        assert abs(sum(p2(h, w) for w in [*frequent, RARE]) - 1) < 1e-9
    out = []
    for d, w in tokens:
        base = sum(math.log10((u[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p2(*p)) for p in pairs(w)) + sum(math.log10(p1(x) / p_rare) for x in w if x not in frequent)
        out.append((d, len(w), sum(x in u for x in w), n, base, score))
    return out


@pytest.mark.parametrize("share", [2.0**-20, 0.02])
def test_against_brute_force(spark, sf, odd_texts, share):
    texts = odd_texts + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id > 130").collect()]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    model, table = backoff.train(docs, share)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in backoff.score(docs, model, table).collect()), key=key)
    wanted = sorted(brute(texts, share), key=key)
    assert [x[:4] for x in found] == [x[:4] for x in wanted]
    np.testing.assert_allclose([x[4:] for x in found], [x[4:] for x in wanted], rtol=1e-9)


def test_better_than_base_on_held_out(spark, sf):
    from mosaiq.llm.queries import op4_backoff

    rows = op4_backoff(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert rows.s > rows.b


def test_discounts():
    for n in ({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 10, 2: 50, 3: 1}, {}, {1: 5}, {7: 3}):
        d = backoff.discounts(n)
        assert len(d) == backoff.K + 2 and (d[1 : backoff.K + 1] > 0).all() and (d[1 : backoff.K + 1] < 1).all() and d[-1] == 1


def test_empty_and_clashing(spark, none, clash):
    assert backoff.train_and_score(none).count() == 0
    assert backoff.train_and_score(clash).count() == clash.count()
    only_held_out = spark.createDataFrame([(i, "a b") for i in range(200) if not backoff.trains(i)], "doc_id long, text string")
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in backoff.train_and_score(only_held_out).collect())


def test_rare_words_keep_their_bigrams(spark, monkeypatch):
    """Results don't depend on which words are cached: with almost none, bigrams of rare words still count."""
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 500)) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(backoff, "CACHED", 0.05)
    found = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in backoff.train_and_score(docs).collect())
    wanted = sorted(brute(texts, 0.0))
    assert [x[:4] for x in found] == [x[:4] for x in wanted]
    np.testing.assert_allclose([x[4:] for x in found], [x[4:] for x in wanted], rtol=1e-9)


def test_tokens_and_keys():
    texts = ["", None, "  A b ", "x", "\ty\x0bz\x0c\r\n", "ÄÖ é\u00a0B\u2003c", "a a  a", "\n"]
    words, codes, sizes = backoff._tokens(pa.array(texts))
    wanted = [[*(t or "").encode().lower().split(), backoff.END_WORD] for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted] and [words[c] for c in codes] == [x for w in wanted for x in w]
    assert backoff._tokens(pa.array([], pa.string()))[2].tolist() == []
    words, codes, sizes = backoff._tokens(pa.array(["one two"]))
    assert [words[c] for c in codes] == [b"one", b"two", backoff.END_WORD] and sizes.tolist() == [3]
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    keys = keys[np.argsort(keys.view(np.uint64))]
    assert (backoff._keys(backoff._planes(keys)) == keys).all() and not len(backoff._keys(backoff._planes(keys[:0])))
