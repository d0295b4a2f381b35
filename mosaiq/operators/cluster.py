"""The life of event clusters: assignment, fusion, closing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.times import hours_before
from mosaiq.functions.urls import non_event
from mosaiq.functions.vectors import unit, vector_sums
from mosaiq.operators.components import connected_components
from mosaiq.operators.ordered import DIGITS, assign_in_order
from mosaiq.operators.similarity import best_match, components_above, linked_above, pairs_above
from mosaiq.params import DEFAULTS, Params
from mosaiq.tables import freed, written


def open_clusters(clusters: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    return clusters.filter((F.col("state") == "open") & (F.col("created_at") >= hours_before(as_of, params.open_hours)))


def clusterable(articles: DataFrame, vectors: DataFrame, membership: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """id, published_at, embedding of loose recent articles on events."""
    recent = articles.filter((F.col("published_at") >= hours_before(as_of, params.open_hours)) & non_event(F.col("url")).isNull())
    loose = recent.join(membership, "article_id", "left_anti")
    return loose.join(vectors.filter("embedding IS NOT NULL"), "article_id").select(F.col("article_id").alias("id"), "published_at", "embedding")


def cluster_sums(clusters: DataFrame, membership: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster_id, vec_sum, n over the members that have vectors."""
    members = membership.join(clusters.select("cluster_id"), "cluster_id", "left_semi").join(vectors, "article_id")
    return vector_sums(members, "cluster_id")


#: Numbers in the vectors of loose articles and clusters that one task takes through the rounds (256 MiB), products that it
#: computes at once, and clusters that are sent to all tasks at once.
ROUNDS_TASK, PRODUCTS, BROADCAST = 1 << 25, 1 << 22, 4096

ASSIGNED = "article_id long, cluster_id long, founder long"


def sequential(ids: np.ndarray, vectors: np.ndarray, cluster_ids: np.ndarray, sums: np.ndarray, threshold: float) -> list[tuple[int, int | None, int | None]]:
    """Greedy assignment of articles in order; (article, cluster, None), or for new clusters (article, None, founder),
    the founder being the article that the evaluated one matched."""
    n, k = len(ids), len(cluster_ids)
    room = np.zeros((k + n // 2 + 1, vectors.shape[1]))
    room[:k] = sums
    centroids = np.zeros_like(room)
    lengths = np.linalg.norm(room[:k], axis=1, keepdims=True)
    centroids[:k] = np.divide(room[:k], lengths, out=room[:k].copy(), where=lengths > 0)
    founders: list[int | None] = [None] * k
    free = np.ones(n, bool)
    out: list[tuple[int, int | None, int | None]] = []

    def recentre(c: int) -> None:
        length = np.linalg.norm(room[c])
        centroids[c] = room[c] / length if length > 0 else room[c]

    for i in range(n):
        if not free[i]:
            continue
        x = vectors[i]
        if k:
            sims = np.round(centroids[:k] @ x, DIGITS)
            c = int(np.argmax(sims))
            if sims[c] >= threshold:
                free[i] = False
                room[c] += x
                recentre(c)
                out.append((int(ids[i]), None if founders[c] is not None else int(cluster_ids[c]), founders[c]))
                continue
        others = np.flatnonzero(free)
        others = others[others != i]
        if len(others):
            sims = np.round(vectors[others] @ x, DIGITS)
            j = int(np.argmax(sims))
            if sims[j] >= threshold:
                y = int(others[j])
                room[k] = x + vectors[y]
                founders.append(int(ids[y]))
                recentre(k)
                k += 1
                free[[i, y]] = False
                out += [(int(ids[y]), None, int(ids[y])), (int(ids[i]), None, int(ids[y]))]
    return out


def assign(articles: DataFrame, vectors: DataFrame, membership: DataFrame, clusters: DataFrame, as_of: Column, params: Params = DEFAULTS, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """New membership rows (article_id, cluster_id) and new clusters.

    The greedy result is the same if it is computed apart for each component of the graph that joins articles at
    threshold squared or more and articles with clusters at the threshold or more. mode: "exact" runs each
    component in one task; "hybrid" does so up to params.component_cap vectors and takes the articles of larger ones
    window by window, with the same result; "rounds" runs all by rounds, an approximation that needs fewer."""
    running = open_clusters(clusters, as_of, params)
    loose = written(clusterable(articles, vectors, membership, as_of, params), "loose")
    sums = written(cluster_sums(running, membership, vectors), "sums")
    if mode == "rounds":
        placed = _rounds(loose, sums, params)
    else:
        # clusters are nodes of negative number
        centroids = sums.select((-1 - F.col("cluster_id")).alias("id"), unit(F.col("vec_sum")).alias("embedding"))
        both = centroids.unionByName(loose.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
        parts = components_above(both, params.threshold**2, params.threshold)
        sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
        parts = parts.join(sizes, "component")
        cap = params.component_cap if mode == "hybrid" else 1 << 62
        nodes = loose.select("id", "published_at", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
        nodes = nodes.unionByName(sums.select((-1 - F.col("cluster_id")).alias("id"), F.lit(None).cast("timestamp").alias("published_at"), F.col("vec_sum").alias("vector")))
        small = nodes.join(parts.filter(F.col("size") <= cap), nodes.id == parts.node).select("component", "id", "published_at", "vector")

        def run(t: pa.Table) -> pa.Table:
            ids = t["id"].to_numpy()
            stamps = t["published_at"].cast(pa.int64()).fill_null(0).to_numpy()
            lists = t["vector"].combine_chunks()
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            is_article = ids >= 0
            order = np.flatnonzero(is_article)[np.lexsort((ids[is_article], stamps[is_article]))]
            old = np.flatnonzero(~is_article)[np.argsort(-ids[~is_article])]
            found = sequential(ids[order], x[order], -1 - ids[old], x[old], params.threshold)
            return pa.table({"article_id": pa.array([a for a, _, _ in found], pa.int64()), "cluster_id": pa.array([b for _, b, _ in found], pa.int64()), "founder": pa.array([c for _, _, c in found], pa.int64())})

        placed = small.groupBy("component").applyInArrow(run, ASSIGNED)
        if mode == "hybrid":
            large = written(parts.filter(F.col("size") > cap).select("node"), "large")
            if large.limit(1).count():
                loose_large = loose.join(large, loose.id == large.node, "left_semi")
                sums_large = sums.join(large, (-1 - sums.cluster_id) == large.node, "left_semi")
                placed = placed.unionByName(assign_in_order(loose_large, sums_large, params))
    # a new cluster's id is a hash of its founder, so that reruns give the same one
    identity = F.coalesce("cluster_id", F.abs(F.xxhash64(F.lit("cluster"), "founder")))
    placed = written(placed.select("article_id", identity.alias("cluster_id"), "founder"), "placed")
    born = placed.filter("founder = article_id").select("article_id", "cluster_id")
    new = born.join(articles, "article_id").select(
        "cluster_id", "title", as_of.alias("created_at"), F.lit("open").alias("state"), F.lit(None).cast("long").alias("articles_at_synthesis")
    )
    return placed.select("article_id", "cluster_id"), new


def _rounds(loose: DataFrame, sums: DataFrame, params: Params, cap: int | None = None) -> DataFrame:
    """All attachments against one snapshot of centroids, again until none; then births: an article that is the
    earliest within two hops of the graph of loose articles pairs with its best neighbour; and so on.

    After a step without attachments no loose article is near any cluster, so later steps only look at clusters that changed,
    and old ones are done with. As soon as loose articles (at first with the clusters) are at most `cap` (by default
    ROUNDS_TASK numbers), one task does the steps that are left. Before that, a step is one job: tasks get the few centroids that changed and return their sums; which
    articles earlier steps took, they find again from the centroids since the table of loose articles was written last."""
    threshold = params.threshold
    at = F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 63)).cast("long"))
    free = written(loose.select("id", at.alias("at"), F.xxhash64(F.struct(F.col("id").alias("c"), F.lit(True).alias("young"))).alias("h"), "embedding"), "free")
    state = sums.select(F.col("cluster_id").alias("c"), F.lit(False).alias("young"), "vec_sum")
    n, width = free.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    cap = ROUNDS_TASK // max(1, width) if cap is None else cap
    placed, alive, since = [], None, Since(threshold)
    few = n + state.count() <= cap
    if not few:
        free, n = _settled(free, n, written(state, "state"), since, placed)
        state = state.limit(0)
    while n > cap and not few:
        born = None if alive is not None else _born(free, since)
        if born is not None:
            if not len(born[0]):
                n = 0
                break
            since.gone |= dict(zip(born[0].tolist(), born[1].tolist(), strict=True)) | dict(zip(born[1].tolist(), born[1].tolist(), strict=True))
            n = _steps(free, n - 2 * len(born[0]), since, born[1], np.ones(len(born[1]), bool), *born[2:])
            if since.size() > SNAPSHOTS:
                free = _flushed(free, since, placed)
            continue
        # where many articles have few neighbours, from the pairs
        free = _flushed(free, since, placed)
        if alive is None:
            near = written(pairs_above(free.select("id", "embedding"), threshold - _HALF), "near")
            alive = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim").unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))
        alive = alive.join(free.select(F.col("id").alias("x")), "x", "left_semi").join(free.select(F.col("id").alias("y")), "y", "left_semi")
        alive = written(alive, "alive")
        if not alive.limit(1).count():
            n = 0
            break
        hit = _first_pairs(free, alive)
        placed.append(hit)
        grown, free = _grown(state, free, hit)
        free, n = _settled(free, free.count(), grown, since, placed)
    free = _flushed(free, since, placed)
    free = free if n else free.limit(0)
    doubles = lambda v: F.transform(v, lambda x: x.cast("double"))
    nodes = state.select("c", "young", F.lit(False).alias("loose"), F.lit(0).cast("long").alias("at"), F.xxhash64(F.struct("c", "young")).alias("h"), doubles("vec_sum").alias("vector"))
    nodes = nodes.unionByName(free.select(F.col("id").alias("c"), F.lit(True).alias("young"), F.lit(True).alias("loose"), "at", "h", doubles("embedding").alias("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            is_loose, young = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("loose", "young"))
            found = by_rounds(t["c"].to_numpy(), young, t["h"].to_numpy(), is_loose, t["at"].to_numpy(), x, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "c", "young"])

    every = nodes.repartition(1).mapInArrow(run, TOLD)
    for part in placed:
        every = every.unionByName(part)
    return every.select(F.col("id").alias("article_id"), F.when(~F.col("young"), F.col("c")).alias("cluster_id"), F.when(F.col("young"), F.col("c")).alias("founder"))


TOLD = "id long, c long, young boolean"
JUDGED = pa.schema([("m", pa.int64()), ("late", pa.bool_()), ("sim", pa.float64()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("embedding", pa.list_(pa.float64()))])
#: Earliest loose articles that all others are compared with; articles without a neighbour among them that tasks may get; and
#: centroids that tasks get before the loose articles are written anew.
EARLY, UNRESOLVED, SNAPSHOTS = 1024, 4096, 32
#: Half a unit of the last digit that products are rounded to.
_HALF = 0.5 * 10.0**-DIGITS


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _centroids(sums: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, lengths, out=sums.copy(), where=lengths > 0)


@dataclass
class Since:
    """What has happened since a table of loose articles was written: the clusters of articles that were born into them,
    and, step by step, names and centroids of the clusters that took articles."""

    threshold: float
    gone: dict[int, int] = field(default_factory=dict)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def size(self) -> int:
        return sum(len(c) for c, _, _ in self.steps)

    def taken(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch (id, .., embedding): vectors, flags of those that are gone, the cluster of each, and whether that is new."""
        x, ids = _vectors(batch.column(batch.num_columns - 1)), batch.column(0).to_numpy()
        born = np.array(sorted(self.gone), np.int64)
        gone, c, young = np.isin(ids, born), np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        c[gone] = [self.gone[i] for i in ids[gone].tolist()]
        for names, new, centres in self.steps:
            left = np.flatnonzero(~gone)
            best, most = nearest_of(x[left], centres)
            hit, best = left[most >= self.threshold], best[most >= self.threshold]
            gone[hit], c[hit], young[hit] = True, names[best], new[best]
        return x, gone, c, young

    def left(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Pieces of batches without what is gone, and their vectors."""
        for batch in batches:
            for piece in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                x, gone, _, _ = self.taken(piece)
                if not gone.all():
                    yield piece.filter(pa.array(~gone)), x[~gone]


def nearest_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each vector, and how near it is."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0)
    sims = np.round(x @ centres.T, DIGITS)
    best = sims.argmax(1)
    return best, sims[np.arange(len(x)), best]


def _steps(free: DataFrame, n: int, since: Since, names: np.ndarray, young: np.ndarray, hashes: np.ndarray, sums: np.ndarray) -> int:
    """Attachments to these clusters, step by step until none; returns how many of the n articles are left. They lie in
    `since`, and the sums of what a step adds are all that the driver gets."""
    order = np.argsort(hashes)
    names, young, sums = names[order], young[order], sums[order].copy()
    changed = np.arange(len(names))
    while len(changed):
        centres = _centroids(sums[changed])

        def run(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            many, more = np.zeros(len(centres), np.int64), np.zeros_like(centres)
            for _, x in since.left(batches):
                best, most = nearest_of(x, centres)
                hit = most >= since.threshold
                np.add.at(many, best[hit], 1)
                np.add.at(more, best[hit], x[hit])
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(many[some]), pa.array(list(more[some]), pa.list_(pa.float64()))], ["k", "n", "more"])

        found = free.select("id", "embedding").mapInArrow(run, "k long, n long, more array<double>").toArrow().combine_chunks()
        since.steps.append((names[changed], young[changed], centres))
        if not found.num_rows:
            since.steps.pop()
            break
        k = found["k"].to_numpy()
        np.add.at(sums, changed[k], _vectors(found["more"].combine_chunks()))
        n -= int(found["n"].to_numpy().sum())
        changed = changed[np.unique(k)]
    return n


def _flushed(free: DataFrame, since: Since, placed: list[DataFrame]) -> DataFrame:
    """free, written anew without what is gone since, which is added to placed."""
    if not since.gone and not since.steps:
        return free

    def took(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            _, gone, c, young = since.taken(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(gone)), pa.array(c[gone]), pa.array(young[gone])], ["id", "c", "young"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch for batch, _ in since.left(batches))

    placed.append(written(free.select("id", "embedding").mapInArrow(took, TOLD), "hit"))
    left = written(free.mapInArrow(kept, free.schema), "free")
    freed(free)
    since.gone, since.steps = {}, []
    return left


def _settled(free: DataFrame, n: int, state: DataFrame, since: Since, placed: list[DataFrame]) -> tuple[DataFrame, int]:
    """Loose articles and their number, after all attachments to the clusters of state (c, young, vec_sum). More than
    BROADCAST changed clusters meet the articles in blocks."""
    changed, many = state, state.count()
    while many > BROADCAST:
        hit = written(_attached(free, changed, since.threshold), "hit")
        if not hit.limit(1).count():
            return free, free.count()
        placed.append(hit)
        state, free = _grown(state, free, hit)
        changed = written(state.join(hit.select("c", "young").distinct(), ["c", "young"], "left_semi"), "changed")
        n, many = free.count(), changed.count()
    if not many:
        return free, n
    held = changed.select("c", "young", F.xxhash64(F.struct("c", "young")).alias("h"), F.transform("vec_sum", lambda x: x.cast("double")).alias("vec_sum")).toArrow().combine_chunks()
    young = held["young"].to_numpy(zero_copy_only=False).astype(bool)
    n = _steps(free, n, since, held["c"].to_numpy(), young, held["h"].to_numpy(), _vectors(held["vec_sum"].combine_chunks()))
    return _flushed(free, since, placed), n


def _before(at: np.ndarray, ids: np.ndarray, other_at: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
    return (at < other_at) | ((at == other_at) & (ids < other_ids))


def _born(free: DataFrame, since: Since) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Articles that are the earliest within two hops, the best neighbours of these, hashes of the clusters named by the latter, and
    sums of both; None if too many articles have no neighbour among the earliest.

    An article that is linked with one of the earliest has its earliest neighbour among them, so those alone can be the first of
    their neighbours: few, and all tasks get them. What is linked with none of the earliest is few, too, and is compared with all."""

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (piece for piece, _ in since.left(batches))

    early = _Articles.of(free.mapInArrow(loose, free.schema).orderBy("at", "id").limit(EARLY).toArrow())
    linked = early.x @ early.x.T >= since.threshold - _HALF
    np.fill_diagonal(linked, False)
    first = np.flatnonzero(linked.any(1) & (linked.argmax(1) > np.arange(len(linked))))
    judged, rest = _judged(free, since, early, early.take(first), None)
    if rest is None:
        return None
    if len(rest.ids):
        nearby = _earliest_neighbours(free, since, rest)
        first = np.flatnonzero(nearby[2] & _before(rest.at, rest.ids, *nearby[:2]))
        if len(first):
            judged += _judged(free, since, early, rest.take(first), (rest.ids, *nearby))[0]
    dimension = early.x.shape[1]
    if not judged:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dimension))
    one, other, hashes, sums = zip(*judged, strict=True)
    return np.array(one, np.int64), np.array(other, np.int64), np.array(hashes, np.int64), np.array(sums)


@dataclass
class _Articles:
    ids: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> _Articles:
        t = t.combine_chunks()
        if not t.num_rows:
            return _Articles(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
        return _Articles(t["id"].to_numpy(), t["at"].to_numpy(), _vectors(t["embedding"].combine_chunks()))

    def take(self, rows: np.ndarray) -> _Articles:
        return _Articles(self.ids[rows], self.at[rows], self.x[rows])

    def linked(self, x: np.ndarray, ids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Products of vectors with these, and flags of links; none has a link with itself."""
        sims = x @ self.x.T
        return sims, (sims >= least) & (ids[:, None] != self.ids)


def _judged(free: DataFrame, since: Since, early: _Articles, some: _Articles, known: tuple[np.ndarray, ...] | None) -> tuple[list[tuple], _Articles | None]:
    """Of articles that come before all their neighbours, those that also come before the neighbours of these: article, best
    neighbour, hash and sum. And the articles that have no neighbour among the earliest; None if there are too many. known: ids
    of these, time and id of the earliest neighbour of each, and whether it has one."""
    least, width = since.threshold - _HALF, len(some.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros(width, bool)  # a neighbour has an earlier one
        best: list[tuple] = [(-np.inf, 0, 0, None)] * width
        for piece, x in since.left(batches):
            ids, at, hashes = (piece.column(c).to_numpy() for c in range(3))
            _, near = early.linked(x, ids, least)
            has, place = near.any(1), near.argmax(1)
            of_at, of_id = np.where(has, early.at[place], at), np.where(has, early.ids[place], ids)
            if known is None:
                k = np.flatnonzero(~has)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), -1)), pa.array(has[k]), pa.array(np.zeros(len(k))), pa.array(ids[k]), pa.array(hashes[k]), pa.array(at[k]), pa.array(list(x[k]), pa.list_(pa.float64()))], schema=JUDGED)
            else:
                order = np.argsort(known[0])
                k = order[np.minimum(np.searchsorted(known[0], ids, sorter=order), len(order) - 1)]
                listed = (known[0][k] == ids) & known[3][k]
                of_at, of_id = np.where(listed, known[1][k], of_at), np.where(listed, known[2][k], of_id)
            sims, near = some.linked(x, ids, least)
            earlier = _before(of_at[:, None], of_id[:, None], some.at, some.ids)
            late |= (near & earlier).any(0)
            for m in np.flatnonzero(near.any(0)):
                rows = np.flatnonzero(near[:, m])
                values = np.round(sims[rows, m], DIGITS)
                j = rows[np.lexsort((ids[rows], -values))[0]]
                better = (-np.round(sims[j, m], DIGITS), int(ids[j])) < (-best[m][0], best[m][1])
                best[m] = (float(np.round(sims[j, m], DIGITS)), int(ids[j]), int(hashes[j]), x[j].tolist()) if better else best[m]
        rows = [{"m": m, "late": bool(late[m]), "sim": best[m][0], "id": best[m][1], "h": best[m][2], "at": 0, "embedding": best[m][3]} for m in range(width) if late[m] or best[m][3] is not None]
        yield pa.RecordBatch.from_pylist(rows, schema=JUDGED)

    # more rows than this are too many articles without a neighbour
    bound = UNRESOLVED + width * free.rdd.getNumPartitions()
    told = free.mapInArrow(run, "m long, late boolean, sim double, id long, h long, at long, embedding array<double>").limit(bound + 1).toArrow().combine_chunks()
    if told.num_rows > bound:
        return [], None
    rest = _Articles.of(told.filter(pc.less(told["m"], 0)))
    best: dict[int, dict | None] = {}
    for r in told.filter(pc.greater_equal(told["m"], 0)).to_pylist():
        m, old = r["m"], best.get(r["m"], r)
        late = old is None or r["late"]
        best[m] = None if late else min(old, r, key=lambda z: (-z["sim"], z["id"]))
    return [(int(some.ids[m]), r["id"], r["h"], some.x[m] + np.array(r["embedding"])) for m, r in sorted(best.items()) if r is not None], rest


def _earliest_neighbours(free: DataFrame, since: Since, some: _Articles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time and id of the earliest neighbour of each of some articles, and whether it has one."""
    least, top = since.threshold - _HALF, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_at, of_id = np.full(len(some.ids), top), np.full(len(some.ids), top)
        for piece, x in since.left(batches):
            ids, at = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            order = np.lexsort((ids, at))
            _, near = some.linked(x[order], ids[order], least)
            place = order[near.argmax(0)]
            sooner = near.any(0) & _before(at[place], ids[place], of_at, of_id)
            of_at[sooner], of_id[sooner] = at[place[sooner]], ids[place[sooner]]
        k = np.flatnonzero(of_at < top)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(of_at[k]), pa.array(of_id[k])], ["k", "at", "id"])

    t = free.mapInArrow(run, "k long, at long, id long").toArrow().combine_chunks()
    k, at, ids = (t[c].to_numpy() for c in ("k", "at", "id"))
    order = np.lexsort((ids, at, k))
    found, first = np.unique(k[order], return_index=True)
    of_at, of_id, has = np.zeros(len(some.ids), np.int64), np.zeros(len(some.ids), np.int64), np.zeros(len(some.ids), bool)
    of_at[found], of_id[found], has[found] = at[order][first], ids[order][first], True
    return of_at, of_id, has


def _first_pairs(free: DataFrame, alive: DataFrame) -> DataFrame:
    """id, c, young: births, from all pairs of loose articles both ways (x, y, sim)."""
    stamp = free.select("id", F.struct("at", "id").alias("at"))
    for _ in range(2):
        far = alive.join(stamp, alive.y == stamp.id).groupBy("x").agg(F.min("at").alias("near_at"))
        stamp = stamp.join(far, stamp.id == far.x, "left").select("id", F.least("at", F.coalesce("near_at", "at")).alias("at"))
    first = stamp.filter("at.id = id").select(F.col("id").alias("x"))
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(F.round("sim", DIGITS)), "y"))
    couples = alive.join(first, "x", "left_semi").withColumn("r", best).filter("r = 1").select("x", "y")
    return written(couples.select(F.explode(F.array("x", "y")).alias("id"), F.col("y").alias("c"), F.lit(True).alias("young")), "births")


def by_rounds(keys: np.ndarray, young: np.ndarray, hashes: np.ndarray, is_loose: np.ndarray, stamps: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of _rounds in memory, on loose articles and clusters; hashes decide between clusters that are as near.
    Returns article, cluster, and whether that is a new one, named by its founder.

    Of its links an article only keeps the earliest, which is looked for anew, from there on, when that neighbour has gone; and
    one that is not the earliest within two hops keeps a neighbour that shows so. Memory is the vectors'."""
    order = np.flatnonzero(is_loose)
    order = order[np.lexsort((keys[order], stamps[order]))]  # articles by time, so that the first neighbour is the earliest
    ids, mixed, x, n = keys[order], hashes[order], vectors[order], len(order)
    old = np.flatnonzero(~is_loose)
    names, fresh = np.concatenate([keys[old], ids]), np.concatenate([young[old], np.ones(n, bool)])
    least, of = threshold - _HALF, np.full(n, -1)
    free, rows = np.ones(n, bool), np.arange(n)  # rows: what x holds, by place; few of them are gone
    near, witness = np.full(n + 1, -1), np.full(n, -1)  # near: n where there is no neighbour

    def settle(clusters: np.ndarray, sums: np.ndarray, by: np.ndarray) -> None:
        clusters, sums = clusters[np.argsort(by)], sums[np.argsort(by)]
        changed = np.arange(len(clusters))
        while len(changed):
            centres, hits = _centroids(sums[changed]), []
            step = max(1, PRODUCTS // len(centres))
            for at in range(0, len(rows), step):
                best, most = nearest_of(x[at : at + step], centres)
                hit = np.flatnonzero((most >= threshold) & free[rows[at : at + step]])
                np.add.at(sums, changed[best[hit]], x[at + hit])
                of[rows[at + hit]] = clusters[changed[best[hit]]]
                hits.append((rows[at + hit], changed[best[hit]]))
            free[np.concatenate([h for h, _ in hits])] = False
            changed = np.unique(np.concatenate([c for _, c in hits]))

    def look(who: np.ndarray) -> None:
        """The earliest neighbours of rows of x, which have none before near."""
        at, size = np.searchsorted(rows, near[rows[who]] + 1), 128
        near[rows[who]] = n
        who, at = who[at < len(rows)], at[at < len(rows)]
        while len(who):
            lo = int(at.min())
            now = at < lo + size
            now[np.cumsum(now) > max(1, PRODUCTS // size)] = False
            some, columns = who[now], np.arange(lo, min(lo + size, len(rows)))
            linked = (x[some] @ x[columns].T >= least) & free[rows[columns]] & (some[:, None] != columns) & (columns >= at[now][:, None])
            has = linked.any(1)
            near[rows[some[has]]] = rows[columns[linked[has].argmax(1)]]
            at[now] = lo + size
            stays = at < len(rows)
            stays[np.flatnonzero(now)[has]] = False
            who, at, size = who[stays], at[stays], min(4096, size * 2)

    if len(old) and n:
        settle(np.arange(len(old)), vectors[old].copy(), hashes[old])
    while True:
        kept = free[rows]
        if np.count_nonzero(kept) < 0.9 * len(rows):
            x, rows = x[kept], rows[kept]
            kept = np.ones(len(rows), bool)
        # articles without a neighbour stay without; a cluster may still take them
        look(np.flatnonzero(kept & (near[rows] < n) & ((near[rows] < 0) | ~free[near[rows] % max(1, n)])))
        here = np.flatnonzero(kept & (near[rows] < n))
        early = here[near[rows[here]] > rows[here]]
        if not len(early):
            break
        places, shown = rows[early], witness[rows[early]]
        sure = (shown >= 0) & free[shown] & (near[shown] < places)
        first: list[int] = []
        for m in early[~sure]:
            sims = x @ x[m]
            linked = (sims >= least) & kept
            linked[np.searchsorted(rows, near[rows[m]])], linked[m] = True, False
            shows = linked & (near[rows] < rows[m])
            if shows.any():
                witness[rows[m]] = rows[shows.argmax()]
            else:
                first.append(m)
        first = first or [int(early[0])]  # rounding alone can make links that hold one way
        pairs = []
        for m in first:
            others = np.flatnonzero((x @ x[m] >= least) & kept)
            others = np.union1d(others[others != m], [np.searchsorted(rows, near[rows[m]])])
            sims = np.round(x[others] @ x[m], DIGITS)
            others = others[sims == sims.max()]
            pairs.append((m, others[ids[rows[others]].argmin()]))
        one, other = np.array(pairs).T
        of[rows[one]] = of[rows[other]] = len(old) + rows[other]
        free[rows[one]] = free[rows[other]] = False
        settle(len(old) + rows[other], x[one] + x[other], mixed[rows[other]])
    some = np.flatnonzero(of >= 0)
    return ids[some], names[of[some]], fresh[of[some]]


def _attached(free: DataFrame, changed: DataFrame, threshold: float) -> DataFrame:
    """id, c, young: loose articles that are near enough to one of the clusters, each with the nearest. Up to BROADCAST
    clusters are sent to the articles; more meet them in blocks."""
    numbered = changed.select(F.xxhash64(F.struct("c", "young")).alias("cluster_id"), "c", "young", unit(F.col("vec_sum")).alias("centroid"))
    few = numbered.orderBy("cluster_id").limit(BROADCAST + 1).toArrow().combine_chunks()
    if few.num_rows > BROADCAST:
        numbered = written(numbered, "centres")
        match = best_match(free.select("id", "embedding"), numbered.select("cluster_id", "centroid"), threshold)
        return match.join(numbered, "cluster_id").select("id", "c", "young")
    c, young = few["c"].to_numpy(), few["young"].to_numpy(zero_copy_only=False)
    if not len(c):
        return free.sparkSession.createDataFrame([], "id long, c long, young boolean")
    centres = few["centroid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                sims = np.round(x @ centres.T, DIGITS)
                best, hit = sims.argmax(1), sims.max(1) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(hit)), pa.array(c[best[hit]]), pa.array(young[best[hit]].astype(bool))], ["id", "c", "young"])

    return free.select("id", "embedding").mapInArrow(run, "id long, c long, young boolean")


def _grown(state: DataFrame, free: DataFrame, hit: DataFrame) -> tuple[DataFrame, DataFrame]:
    more = vector_sums(free.join(hit, "id").select(F.struct("c", "young").alias("who"), "embedding"), "who").select("who.c", "who.young", "vec_sum")
    parts = state.select("c", "young", "vec_sum").unionByName(more).select(F.struct("c", "young").alias("who"), F.col("vec_sum").alias("embedding"))
    grown = vector_sums(parts, "who").select("who.c", "vec_sum", "who.young")
    return written(grown, "state"), written(free.join(hit.select("id"), "id", "left_anti"), "free")


def run_counters(placed: DataFrame, born: DataFrame, evaluated: DataFrame | None = None) -> DataFrame:
    """One row: attached articles and created clusters of a run; with the loose articles that it evaluated also their
    number and how many stayed loose."""
    out = placed.agg(F.count("*").alias("attached")).join(born.agg(F.count("*").alias("created")))
    if evaluated is None:
        return out
    return out.join(evaluated.agg(F.count("*").alias("evaluated"))).withColumn("unmatched", F.col("evaluated") - F.col("attached"))


def fusion_survivors(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """cluster_id, survivor: the oldest cluster (then the lowest id) of each group (cluster_id, component)."""
    rows = clusters.join(groups, "cluster_id")
    oldest = rows.groupBy("component").agg(F.min_by("cluster_id", F.struct("created_at", "cluster_id")).alias("survivor"))
    return rows.join(oldest, "component").select("cluster_id", "survivor")


def fuse(clusters: DataFrame, membership: DataFrame, vectors: DataFrame, angles: DataFrame | None, as_of: Column, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Clusters after joining, again and again, groups whose centroids (of one snapshot) are near. Articles and
    angles move to the oldest; the survivor's mark is the greatest of the group's; the others' rows go."""
    stale: list[DataFrame] = []
    while True:
        running = open_clusters(clusters, as_of, params)
        sums = cluster_sums(running, membership, vectors)
        groups = connected_components(linked_above(sums.select(F.col("cluster_id").alias("id"), unit(F.col("vec_sum")).alias("embedding")), params.fusion))
        if not groups.limit(1).count():
            return clusters, membership, angles
        moves = written(fusion_survivors(clusters, groups.select(F.col("node").alias("cluster_id"), "component")), "moves")
        moved = lambda rows: written(rows.join(moves, "cluster_id", "left").withColumn("cluster_id", F.coalesce("survivor", "cluster_id")).drop("survivor"), "moved")
        marks = clusters.join(moves, "cluster_id").groupBy("survivor").agg(F.max("articles_at_synthesis").alias("mark"))
        kept = clusters.join(moves.filter("cluster_id <> survivor"), "cluster_id", "left_anti").join(marks, F.col("cluster_id") == F.col("survivor"), "left")
        columns = clusters.columns
        clusters = written(kept.withColumn("articles_at_synthesis", F.coalesce("mark", "articles_at_synthesis")).select(*columns), "clusters")
        membership = moved(membership)
        angles = None if angles is None else moved(angles)
        freed(moves, *stale)
        stale = [clusters, membership, *([] if angles is None else [angles])]


def close_expired(clusters: DataFrame, membership: DataFrame, articles: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """clusters with those past their time processed, if enough outlets reported, or discarded."""
    counts = membership.join(articles.select("article_id", "outlet_id"), "article_id").groupBy("cluster_id").agg(F.count_distinct("outlet_id").alias("outlets"))
    due = (F.col("state") == "open") & (F.col("created_at") < hours_before(as_of, params.open_hours))
    verdict = F.when(F.coalesce("outlets", F.lit(0)) >= params.min_outlets, "processed").otherwise("discarded")
    return clusters.join(counts, "cluster_id", "left").withColumn("state", F.when(due, verdict).otherwise(F.col("state"))).select(*clusters.columns)


def at(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp")
