"""The engine's cycle: ingest, vectorise, close, assign, fuse, expire, synthesise and deliver, over durable tables."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import cluster, delivery, ingest, synthesis, vectorise
from mosaiq.params import DEFAULTS, Params
from mosaiq.sources.store import Store
from mosaiq.tables import freed, written

#: The tables of the store; `angles` only where something synthesises.
TABLES = ("articles", "vectors", "membership", "clusters")


@dataclass
class State:
    """The store with the tables between cycles, and what the caller gives: outlets and pages. Articles and vectors
    are only added to; the small tables of clusters are replaced where a step changes them."""

    store: Store
    outlets: DataFrame
    pages: DataFrame
    angles: DataFrame | None = None
    log: list[tuple[str, str, str, str | None]] = field(default_factory=list)

    @staticmethod
    def begin(store: Store, outlets: DataFrame, pages: DataFrame, **tables: DataFrame) -> State:
        """A store's first versions, of the TABLES given."""
        with store.commit() as c:
            for name in TABLES:
                c.replace(tables[name], name)
        return State(store, outlets, pages)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.store.read(name)
        raise AttributeError(name)


Encode = Callable[[DataFrame, str, str], DataFrame]


def run_cycle(
    state: State,
    items: DataFrame,
    as_of: Column,
    encode: Encode,
    deliver: Callable[[DataFrame], DataFrame] | None = None,
    synthesise: Callable[[State], None] | None = None,
    params: Params = DEFAULTS,
    vector_limit: int | None = None,
) -> DataFrame:
    """Runs the steps in order and returns one row a step: step, status, detail, and the trace of an error. Each step changes
    its tables by one commit, so a failing one leaves all of them as they were, whatever it had written; it doesn't stop the
    others, but synthesis only follows a successful fusion; delivery always runs."""
    store = state.store

    def step(name: str, work: Callable[[], str]) -> bool:
        try:
            state.log.append((name, "done", work(), None))
            return True
        except Exception as e:  # noqa: BLE001  a step's failure is data
            state.log.append((name, "failed", f"{type(e).__name__}: {e}"[:500], traceback.format_exc()))
            return False

    def do_ingest() -> str:
        articles = state.articles
        judged = written(ingest.verdicts(items, state.outlets, articles, state.pages), "judged")
        fresh = judged.filter("verdict = 'new'").select(*articles.columns)
        n = fresh.count()
        if n:
            store.append(fresh, "articles")
        freed(judged)
        return f"{n} new"

    def do_vectors() -> str:
        waiting = vectorise.pending(state.articles, state.vectors, vector_limit)
        store.append(vectorise.encoded(waiting, encode, params), "vectors")
        return ""

    def do_close() -> str:
        store.replace(cluster.close_expired(state.clusters, state.membership, state.articles, as_of, params), "clusters")
        return ""

    def do_assign() -> str:
        clusters = state.clusters
        placed, born = cluster.assign(state.articles, state.vectors, state.membership, clusters, as_of, params)
        placed, born = written(placed, "placed"), written(born.select(*clusters.columns), "born")
        with store.commit() as c:
            c.append(born, "clusters")
            c.append(placed, "membership")
        counts = cluster.run_counters(placed, born).first()
        freed(placed, born)
        return f"{counts['attached']} attached, {counts['created']} created"

    def do_fuse() -> str:
        clusters, membership, angles = cluster.fuse(state.clusters, state.membership, state.vectors, state.angles, as_of, params)
        with store.commit() as c:
            c.replace(membership, "membership")
            c.replace(clusters, "clusters")
            if angles is not None:
                c.replace(angles, "angles")
        if angles is not None:
            state.angles = store.read("angles")
        return ""

    def do_expire() -> str:
        marked, alerts = synthesis.expire(state.clusters, state.membership, state.articles, as_of, params)
        totals = synthesis.expired_totals(alerts).first()
        store.replace(marked, "clusters")
        return f"{totals['n_clusters']} clusters, {totals['n_articles']} articles"

    def do_deliver() -> str:
        if state.angles is None or deliver is None:
            return "nothing"
        results = written(deliver(delivery.pending(state.angles, params=params)), "results")
        state.angles = store.replace(delivery.fold(state.angles, results, as_of, params).drop("outcome", "newly_exhausted"), "angles")
        freed(results)
        return ""

    state.log = []
    step("ingest", do_ingest)
    step("vectorise", do_vectors)
    grouped = step("close", do_close) and step("assign", do_assign) and step("fuse", do_fuse)
    # without a model nothing expires, as nothing could have been synthesised
    if synthesise is not None:
        step("expire", do_expire)
        if grouped:
            step("synthesise", lambda: synthesise(state) or "")
    step("deliver", do_deliver)
    store.tidy()
    return items.sparkSession.createDataFrame(state.log, "step string, status string, detail string, trace string")
