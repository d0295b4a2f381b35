"""Exact greedy assignment of any number of articles: a bounded window of them at a time, in order.

A window's decisions depend on little of what lies outside it. A cluster takes its first article of a window only if that
article is at the threshold to the cluster's centroid as the window found it, so clusters that no article of the window is
near can be left aside. A loose article outside the window goes only as the partner of one inside, so the few nearest of
each article of the window suffice until all of them have gone; where that happens, the window ends there and the next one
begins with that article. Most articles of a window find a cluster, and need no partner: partners are only looked for those
that are near the threshold to all clusters as the window found them, or below; where another one finds no cluster after all,
the window ends there, too. Each round finds these by matrix products spread over the cluster, and one task, whose memory is
set by the window, replays the greedy loop on them. The result is that of one loop over all articles, at the cost of a
round for each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.params import DEFAULTS, Params
from mosaiq.tables import freed, written

#: Articles of a window, those of it whose partners are looked for (fewer where that is more than PRODUCTS), and neighbours outside
#: it that are held for each of these.
WINDOW = 32_768
ASKED, PRODUCTS = 16_384, 1 << 33
NEIGHBOURS = 4
#: An article whose nearest cluster is closer to the threshold than NEAR is always asked for, one closer than FAR while ASKED allows
#: it. Clusters move the less the more articles they have, so FAR shrinks after STEADY windows.
NEAR, FAR, STEADY = 0.02, 0.15, 2
#: Loose articles that a task multiplies with a window at once.
CHUNK = 256
#: Products are compared after rounding, so that equal vectors tie however they are multiplied.
DIGITS = 12
_SLACK = 1e-9

_INPUT = "kind int, key long, young boolean, turn long, vector array<double>, near int, stamp long, sim double"
_OUTPUT = "kind string, article_id long, key long, young boolean, turn long, vector array<double>"


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _unit(sums: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(sums, axis=-1, keepdims=True)
    return np.divide(sums, lengths, out=sums.copy(), where=lengths > 0)


def _nearest(centres: DataFrame, x: np.ndarray) -> np.ndarray:
    """For each article of the window, how near the nearest cluster is; tasks return a number an article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(x), -np.inf)
        for batch in batches:
            sums = _rows(batch.column(0), x.shape[1])
            for at in range(0, len(sums), CHUNK):
                heads = _unit(sums[at : at + CHUNK]).T
                for place in range(0, len(x), 4096):
                    np.maximum(best[place : place + 4096], (x[place : place + 4096] @ heads).max(axis=1), out=best[place : place + 4096])
        if not np.isneginf(best).all():
            yield pa.RecordBatch.from_arrays([pa.array([best], pa.list_(pa.float64()))], ["best"])

    t = centres.select("vector").mapInArrow(run, "best array<double>").toArrow()
    return _rows(t["best"].combine_chunks(), len(x)).max(axis=0) if t.num_rows else np.full(len(x), -np.inf)


def _asked(best: np.ndarray, threshold: float, asked: int, far: float = FAR) -> tuple[int, np.ndarray]:
    """Where a window ends, by how near the nearest cluster of each article is, and the places whose partners are looked for."""
    unsure = np.flatnonzero(best < threshold + min(NEAR, far))
    end = len(best) if len(unsure) <= asked else int(unsure[asked])
    order = np.argsort(best[:end], kind="stable")[:asked]
    return end, np.sort(order[best[order] < threshold + far])


def _reached(centres: DataFrame, x: np.ndarray, threshold: float) -> DataFrame:
    """The clusters that some article of the window is near enough to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = _rows(batch.column(3), x.shape[1])
                hit = np.zeros(len(sums), bool)
                for at in range(0, len(sums), CHUNK):
                    heads = _unit(sums[at : at + CHUNK])
                    for place in range(0, len(x), 4096):
                        hit[at : at + CHUNK] |= (heads @ x[place : place + 4096].T).max(axis=1) >= threshold - _SLACK
                yield batch.filter(pa.array(hit))

    return centres.select("key", "young", "turn", "vector").mapInArrow(run, "key long, young boolean, turn long, vector array<double>")


def _partners(free: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float, k: int) -> DataFrame:
    """near, key, stamp, sim: for each vector of x (by its place there) the k best loose articles outside the window, which
    has these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # place, sim, stamp, id of the best so far, and what others must reach
        best = [np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        bound = np.full(len(x), threshold - _SLACK)
        for batch in batches:
            outside = np.flatnonzero(~np.isin(batch.column(0).to_numpy(), ids))
            for at in range(0, len(outside), CHUNK):
                part = batch.take(pa.array(outside[at : at + CHUNK]))
                sims = x @ _rows(part.column(2), x.shape[1]).T
                hit = sims >= bound[:, None]
                if sims.shape[1] > k and np.count_nonzero(hit) > 16 * k * len(x):
                    hit = sims >= np.maximum(bound, np.partition(sims, -k, axis=1)[:, -k] - _SLACK)[:, None]
                place, other = np.nonzero(hit)
                if not len(place):
                    continue
                found = (place.astype(np.int32), np.round(sims[place, other], DIGITS), part.column(1).to_numpy()[other], part.column(0).to_numpy()[other])
                best = [np.concatenate(z) for z in zip(best, found, strict=True)]
                order = np.lexsort((best[3], best[2], -best[1], best[0]))
                best = [z[order] for z in best]
                nth = np.arange(len(order)) - np.searchsorted(best[0], best[0])
                bound[best[0][nth == k - 1]] = np.maximum(best[1][nth == k - 1], threshold) - _SLACK
                best = [z[nth < k] for z in best]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[3]), pa.array(best[2]), pa.array(best[1])], ["near", "key", "stamp", "sim"])

    found = free.select("id", "stamp", "vector").mapInArrow(run, "near int, key long, stamp long, sim double")
    rank = F.row_number().over(Window.partitionBy("near").orderBy(F.desc("sim"), "stamp", "key"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def replay(ids: np.ndarray, stamps: np.ndarray, x: np.ndarray, centres: list[tuple], partners: dict[int, list[tuple]], k: int, threshold: float, turn: int, asked: np.ndarray | None = None) -> tuple[list[tuple], list[tuple], int]:
    """The greedy loop over a window. centres: (young, turn, key, sum) in their order; partners: for places of the window,
    (sim, stamp, id, vector) of loose articles outside, best first, looked for at the places asked (None: all). Returns what was placed (article, key, young), the
    clusters that changed (key, young, turn, sum), and how many articles were decided."""
    n, many = len(ids), len(centres)
    room = np.zeros((many + n, x.shape[1]))
    if many:
        room[:many] = [c[3] for c in centres]
    heads = np.zeros_like(room)
    heads[:many] = _unit(room[:many])
    names = [(c[2], c[0], c[1]) for c in centres]
    changed: set[int] = set()
    inside, gone = np.ones(n, bool), set()
    known = np.ones(n, bool) if asked is None else np.isin(np.arange(n), asked)
    placed: list[tuple] = []
    for i in range(n):
        if not inside[i]:
            continue
        if names:
            sims = np.round(heads[: len(names)] @ x[i], DIGITS)
            c = int(np.argmax(sims))
            if sims[c] >= threshold:
                inside[i] = False
                room[c] += x[i]
                heads[c] = _unit(room[c])
                changed.add(c)
                placed.append((int(ids[i]), names[c][0], names[c][1]))
                continue
        if not known[i]:
            return placed, [(*names[c], room[c]) for c in sorted(changed)], i
        listed = partners.get(i, [])
        outer = next((p for p in listed if p[2] not in gone), None)
        if outer is None and len(listed) == k:
            return placed, [(*names[c], room[c]) for c in sorted(changed)], i  # more may be outside than are listed
        others = np.flatnonzero(inside)
        others = others[others != i]
        sims = np.round(x[others] @ x[i], DIGITS)
        j = int(np.argmax(sims)) if len(others) else -1
        inner = (-sims[j], int(stamps[others[j]]), int(ids[others[j]])) if len(others) else None
        if outer is not None and (inner is None or (-outer[0], outer[1], outer[2]) < inner):
            sim, y, vector = outer[0], outer[2], outer[3]
        elif inner is not None:
            sim, y, vector = float(sims[j]), inner[2], x[others[j]]
        else:
            continue
        if sim < threshold:
            continue
        if outer is not None and y == outer[2]:
            gone.add(y)
        else:
            inside[others[j]] = False
        inside[i] = False
        c = len(names)
        room[c] = x[i] + vector
        heads[c] = _unit(room[c])
        names.append((y, True, turn))
        turn += 1
        changed.add(c)
        placed += [(y, y, True), (int(ids[i]), y, True)]
    return placed, [(*names[c], room[c]) for c in sorted(changed)], n


def assign_in_order(loose: DataFrame, sums: DataFrame, params: Params = DEFAULTS, window: int = WINDOW, neighbours: int = NEIGHBOURS, asked_of: int = ASKED) -> DataFrame:
    """article_id, cluster_id, founder of the articles that find a cluster, as the greedy loop over all of loose (id,
    published_at, embedding) by time and id, from clusters (cluster_id, vec_sum). New clusters have a founder, not an id."""
    spark, threshold = loose.sparkSession, params.threshold
    # in order, so that later articles are read alone
    stamped = loose.select("id", F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("stamp"), F.col("embedding").alias("vector"))
    stamped = written(stamped.orderBy("stamp", "id"), "stamped")
    centres = written(sums.select(F.col("cluster_id").alias("key"), F.lit(False).alias("young"), F.lit(0).cast("long").alias("turn"), F.col("vec_sum").alias("vector")), "centres")
    placed = written(spark.createDataFrame([], "article_id long, key long, young boolean"), "placed")
    at = F.struct("stamp", "id")
    place = lambda stamp, key: F.struct(F.lit(stamp).cast("long").alias("stamp"), F.lit(key).cast("long").alias("id"))
    cursor: tuple[int, int] | None = None
    turn, decided = 1, 0
    most = max(1, min(asked_of, PRODUCTS // max(1, stamped.count())))
    while True:
        taken = placed.select(F.col("article_id").alias("id"))
        free = stamped.join(taken, "id", "left_anti")
        # up to and with the cursor all are decided
        later = stamped if cursor is None else stamped.filter(F.col("stamp") >= cursor[0]).filter(at > place(*cursor))
        later = later.join(taken, "id", "left_anti")
        last = later.select("stamp", "id").orderBy("stamp", "id").limit(window).agg(F.max(at).alias("last")).first()["last"]
        if last is None:
            break
        # a window: bounded
        rows = later.filter((F.col("stamp") <= last["stamp"]) & (at <= place(*last))).select("id", "stamp", "vector").toArrow().combine_chunks()
        rows = rows.sort_by([("stamp", "ascending"), ("id", "ascending")]).combine_chunks()
        width = len(rows["vector"][0])
        x = _rows(rows["vector"].combine_chunks(), width)
        end, asked = _asked(_nearest(centres, x), threshold, most, FAR * min(1.0, STEADY * window / max(1, decided)))
        ids, stamps, x = rows["id"].to_numpy()[:end], rows["stamp"].to_numpy()[:end], x[:end]
        near = written(_partners(free, ids, x[asked], threshold, neighbours), "partners")
        vectors = free.join(F.broadcast(near.select(F.col("key").alias("id")).distinct()), "id").select(F.col("id").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
        one = spark.range(1).selectExpr("0 AS kind", "CAST(NULL AS LONG) AS key", "false AS young", "0L AS turn", "CAST(NULL AS ARRAY<DOUBLE>) AS vector", "0 AS near", "0L AS stamp", "0D AS sim")
        given = one.unionByName(_reached(centres, x, threshold).withColumn("kind", F.lit(1)), allowMissingColumns=True)
        given = given.unionByName(near.join(vectors, "key").withColumn("kind", F.lit(2)), allowMissingColumns=True)
        first_turn = turn

        def run(batches: Iterator[pa.RecordBatch], ids=ids, stamps=stamps, x=x, asked=asked, turn=first_turn) -> Iterator[pa.RecordBatch]:
            known, partners = [], {}
            for batch in batches:
                of = batch.column(0).to_numpy()
                columns = lambda t, *names: [t.column(t.schema.get_field_index(n)).to_pylist() for n in names]
                for kind in (1, 2):
                    part = batch.filter(pa.array(of == kind))
                    vectors_of = _rows(part.column(4), x.shape[1])
                    if kind == 1:
                        known += zip(*columns(part, "young", "turn", "key"), vectors_of, strict=True)
                    else:
                        for place, *rest in zip(*columns(part, "near", "sim", "stamp", "key"), vectors_of, strict=True):
                            partners.setdefault(int(asked[place]), []).append(tuple(rest))
            known.sort(key=lambda c: c[:3])
            for listed in partners.values():
                listed.sort(key=lambda p: (-p[0], p[1], p[2]))
            new, changed, done = replay(ids, stamps, x, known, partners, neighbours, threshold, turn, asked)
            told = [("placed", a, b, c, None, None) for a, b, c in new] + [("centre", None, a, b, c, v.tolist()) for a, b, c, v in changed] + [("done", None, None, None, done, None)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), types, strict=True)], ["kind", "article_id", "key", "young", "turn", "vector"])

        told = written(given.select(*[c.split()[0] for c in _INPUT.split(", ")]).repartition(1).mapInArrow(run, _OUTPUT), "told")
        done = told.filter("kind = 'done'").first()["turn"]
        turn, decided = turn + window, decided + done
        cursor = (int(stamps[done - 1]), int(ids[done - 1])) if done else cursor
        touched = told.filter("kind = 'centre'").select("key", "young", "turn", "vector")
        old = [centres, placed]
        centres = written(centres.join(touched.select("key", "young"), ["key", "young"], "left_anti").unionByName(touched), "centres")
        placed = written(placed.unionByName(told.filter("kind = 'placed'").select("article_id", "key", "young")), "placed")
        freed(near, told, *old)
    freed(stamped, centres)
    return placed.select("article_id", F.when(~F.col("young"), F.col("key")).alias("cluster_id"), F.when(F.col("young"), F.col("key")).alias("founder"))
