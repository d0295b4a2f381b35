"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mosaiq.llm import periodic, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w, least=12):
    """All runs (start, end, period) by comparing the words with themselves at every distance."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def digests(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return len(runs), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def changed(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def sequences(seed, trials):
    rng = random.Random(seed)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 240:
        fib.append(fib[-1] + fib[-2])
    for trial in range(trials):
        n, kind, w = rng.randrange(1, 220), trial % 5, []
        if kind == 0:
            w = [rng.randrange(2) for _ in range(n)]
        elif kind == 1:  # repeats of short words, of many exponents
            while len(w) < n:
                u = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
                w += u * rng.randrange(1, 20) + u[: rng.randrange(len(u) + 1)]
        elif kind == 2:  # highly periodic halves that touch at a break of the phase
            u = [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
            for _ in range(rng.randrange(2, 5)):
                w += u * rng.randrange(8, 20) + u[: rng.randrange(len(u) + 1)]
        elif kind == 3:
            w = list(fib[-1][: n + 12])
        else:
            w = [rng.randrange(50) for _ in range(n)]
            a = rng.randrange(n)
            w[a:] = [w[a + i % (1 + (n - a) // (3 + rng.randrange(8)))] for i in range(n - a)]
        yield w


def test_runs_of_sequences():
    for w in sequences(5, 600):
        assert [tuple(map(int, r)) for r in periodic.runs_of(np.array(w, np.int64), len(w))] == brute(w)


def test_texts_in_one_slice_do_not_touch():
    texts = [" ".join(map(str, w)) for w in sequences(6, 120)]
    for text, found in zip(texts, periodic.measure([t.encode() for t in texts]), strict=True):
        assert found[1] == len(brute(text.split()))
        assert found[6] == "".join(f"{s},{e - s},{q}\n" for s, e, q in brute(text.split()))


def test_synchronising_positions_depend_on_their_context_and_are_dense():
    rng = random.Random(1)
    part = [rng.randrange(4) for _ in range(200)]
    words = np.array([*part, 9, *part, 8, *part], np.int64)
    windows = periodic.Windows(words)
    for k in (2, 3, 4):
        tau = 1 << k
        # by the definition: windows whose least period is at most a third of their length
        least = lambda x: next(p for p in range(1, len(x) + 1) if (x[p:] == x[:-p]).all() or p == len(x))
        high = np.array([3 * least(words[i : i + tau]) <= tau for i in range(len(words) - tau + 1)] + [False] * (tau - 1))
        found = set(periodic.synchronising(windows, k, high).tolist())
        seen = {}
        for i in range(len(words) - 2 * tau + 1):
            assert seen.setdefault(tuple(words[i : i + 2 * tau]), i in found) == (i in found)
        for i in range(len(words) - 3 * tau + 2):
            assert bool(found & set(range(i, i + tau))) != (3 * least(words[i : i + 3 * tau - 1]) <= tau)


def test_long_runs():
    a = periodic.runs_of(np.zeros(300_000, np.int64), 300_000)
    assert a.tolist() == [[0, 300_000, 1]]
    rng = np.random.default_rng(3)
    word = rng.integers(0, 1000, 70_001)
    assert periodic.runs_of(np.concatenate([word, word, word[:50]]), 140_052).tolist()[-1] == [0, 140_052, 70_001]


def test_query_equals_brute_force(spark, sf):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        w = changed(r.doc_id, r.text)
        if len(w) <= 1500:
            assert found[r.doc_id] == digests(w), r.doc_id


def test_odd_rows(odd, odd_texts, none, clash):
    from collections import Counter

    assert periodic.find(none).count() == 0
    assert Counter((r.doc_id, r.n_words, r.n_runs) for r in periodic.find(odd).collect()) == Counter((d, len(WORD.findall(t or "")), len(brute(WORD.findall(t or "")[:3000]))) for d, t in odd_texts)
    out = periodic.find(clash)
    assert out.count() == clash.count() and dict(out.dtypes)["start"] == "bigint" and "source" in out.columns
    assert periodic.planted(odd).count() == odd.count()


@pytest.mark.parametrize("n", [0, 1, 5, 11, 12, 23, 24])
def test_short(n):
    w = [7] * n
    assert periodic.runs_of(np.array(w, np.int64), n).tolist() == ([[0, n, 1]] if n >= 12 else [])
