"""Joins over blocks of near vectors against all products."""

import numpy as np
import pytest

from mosaiq.operators import components, similarity


def sample(kind, n=300, d=12):
    """Vectors in groups, or without structure, or of all lengths with zeros, or a third of them copies of one."""
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(n, d))
    if kind != "loose":
        x = rng.normal(size=(12, d))[rng.integers(12, size=n)] + x * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.exponential(size=(n, 1))
        x[::17] = 0
    if kind == "copies":
        x[: n // 3] = x[0]
    return x


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(5)


KINDS = ["groups", "loose", "lengths", "copies"]


@pytest.mark.parametrize("kind", KINDS)
def test_pairs_and_forests(spark, kind):
    x = sample(kind)
    df, sims = frame(spark, x), np.round(x @ x.T, 12)
    for threshold in (0.9, 0.3, -0.2):
        found = {(r.a, r.b): r.sim for r in similarity.pairs_above(df, threshold + 1e-9, block=16).collect()}
        u, v = np.nonzero(np.triu(sims >= threshold + 1e-9, 1))
        assert set(found) == set(zip(u.tolist(), v.tolist(), strict=True))
        assert all(abs(s - sims[p]) < 1e-9 for p, s in found.items())
    low = np.arange(len(x)) < 40
    u, v = np.nonzero(np.triu(np.where(low[:, None] & low, False, np.where(low[:, None] | low, sims >= 0.95, sims >= 0.8)), 1))
    label = components.least_labels(u, v, len(x))
    parts = components.connected_components(similarity.linked_above(frame(spark, x, -40), 0.8, 0.95, block=16))
    assert {r.node + 40: r.component + 40 for r in parts.collect()} == {int(i): int(label[i]) for i in np.unique(np.concatenate([u, v]))}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("floor", [None, 0.7])
def test_nearest(spark, kind, floor):
    x = sample(kind)
    q = np.concatenate([x[::7], -x[:5], sample("loose", 20), x[:1] * 0])
    sims = np.round(q @ x.T, 12)
    found = {}
    for r in similarity.nearest(frame(spark, q, 1000), frame(spark, x), 4, floor, block=16).collect():
        found.setdefault(r.query_id - 1000, {})[r.rank] = (r.id, round(r.sim, 9))
    for i, row in enumerate(sims):
        wanted = [(j, round(float(row[j]), 9)) for j in sorted(range(len(x)), key=lambda j: (-row[j], j))[:4]]
        got = [found.get(i, {})[k] for k in sorted(found.get(i, {}))]
        if floor is not None:
            wanted, got = ([p for p in pairs if p[1] >= floor] for pairs in (wanted, got))
        if kind == "copies":  # equal but for the last digits
            wanted, got = ([s for _, s in pairs] for pairs in (wanted, got))
        assert got == wanted


def test_blocks_are_skipped(spark):
    met = similarity.blocks_met(frame(spark, sample("groups", 600)), 0.8, block=16).first()
    assert met.met < met.pairs / 4 and met.products < met.all_products / 8
    every = similarity.blocks_met(frame(spark, sample("loose", 600)), -1.0, block=16).first()
    assert every.met == every.pairs and every.products == every.all_products


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = frame(spark, sample("groups", 60)).unionByName(spark.createDataFrame([(None, [1.0] * 12), (900, None)], "id long, embedding array<double>"))
    assert similarity.pairs_above(none, 0.5, block=16).count() == 0
    assert similarity.nearest(none, some, 3, block=16).count() == 0
    assert similarity.nearest(some, none, 3, block=16).count() == 0
    assert {r.query_id for r in similarity.nearest(some, some, 3, block=16).collect()} == set(range(60))
    assert similarity.blocks_met(none, 0.5).first().met == 0


def test_blocks_of_large_inputs_stay_few(spark, monkeypatch):
    """However small blocks are asked for, what is sent grows with a bounded number of blocks, with the same pairs."""
    monkeypatch.setattr(similarity, "MANY", 4)
    x = sample("loose", 200)
    df, sims = frame(spark, x), x @ x.T
    sent = similarity._block_pairs(df, 2, -1.0).groupBy("id").count().agg({"count": "max"}).first()[0]
    assert sent <= 8
    found = {(r.a, r.b) for r in similarity.pairs_above(df, 0.5, block=2).collect()}
    assert found == set(zip(*(i.tolist() for i in np.nonzero(np.triu(sims >= 0.5, 1))), strict=True))


def test_top_of_rows_with_ties():
    rng = np.random.default_rng(5)
    sims = rng.integers(-3, 4, (50, 40)) / 3 + rng.choice([0, 1e-14], (50, 40))
    for k in (1, 4, 40, 60):
        for least in (np.full(50, -np.inf), np.full(50, 0.3)):
            row, column, values = similarity._top(sims, k, least)
            for i, r in enumerate(np.round(sims, 12)):
                wanted = [j for j in sorted(range(40), key=lambda j: (-r[j], j))[:k] if r[j] >= least[i]]
                assert column[row == i].tolist() == wanted and values[row == i].tolist() == r[wanted].tolist()
