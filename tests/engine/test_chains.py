"""Greedy choices along chains: by components in one task each, and by rounds where these are too large."""

import random

import numpy as np
import pytest
from test_rules import greedy_dedup

from mosaiq.operators import components, ingest


# by rounds; a component a task; all in one
@pytest.mark.parametrize("cap", [0, 25, 1000])
def test_components_of_duplicates(spark, cap):
    rng = random.Random(8)
    any_of = lambda c, case: rng.choice([None, *[f"{c}{case}-{i}" for i in range(6)]])
    cases = [[(100 * case + i, any_of("g", case), any_of("u", case)) for i in range(14)] for case in range(12)]
    batch = spark.createDataFrame([r for case in cases for r in case], "o long, guid string, url string").repartition(4)
    found = ingest.first_of_duplicates(batch, "o", small=0, cap=cap)
    assert sorted(r.o for r in found.collect()) == sorted(o for case in cases for o in greedy_dedup(case))


@pytest.mark.parametrize("cap", [0, 60, 1000])
def test_components_of_matches(spark, cap):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(70)} | {(i, i + 1) for i in range(100, 109)}
    chosen = set()
    for x in sorted({x for e in edges for x in e}):
        if not any((y, x) in edges for y in chosen):
            chosen.add(x)
    found = components.first_independent(spark.createDataFrame(list(edges), "u long, v long"), cap)
    assert sorted(r.node for r in found.collect()) == sorted(chosen)


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("id AS o", "concat('g', CAST((id + 1) / 2 AS INT)) AS guid", "concat('u', CAST(id / 2 AS INT)) AS url")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        kept = ingest.first_of_duplicates(rows, "o")
        # every row but each second shares a key with a kept one
        assert kept.count() == n // 2 and kept.filter("o % 2 = 1").count() == 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 30
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_giant_components_by_rounds(spark):
    """One large component, whose nodes are structs, as one task would decide it."""
    rng = np.random.default_rng(6)
    pairs = np.unique(np.sort(rng.integers(0, 120, (400, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]].tolist()
    named = spark.createDataFrame(pairs, "a int, b int").selectExpr("named_struct('k', 1, 'n', a) AS u", "named_struct('k', 1, 'n', b) AS v")
    free, later = {}, {}
    for a, b in pairs:
        later.setdefault(b, []).append(a)
    for n in sorted({x for p in pairs for x in p}):
        free[n] = not any(free[a] for a in later.get(n, []))
    found = components.first_independent(named, 5)
    # rounds leave one table to read, however many there were, and no table goes through the driver
    text = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.node.n for r in found.collect()) == [n for n in sorted(free) if free[n]]
    assert text.count("Scan parquet") <= 6 and "BroadcastExchange" not in text
