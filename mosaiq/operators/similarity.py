"""Exact similarity joins of vectors, in blocks.

Vectors are grouped around centres, and groups near each other share a block. The angle between two vectors is at least
the angle of the one to the other's centre less the greatest angle in that group, which bounds their dot product from
above: a vector only goes to blocks with a group for which the bound reaches the threshold. Where the vectors have no
structure, all blocks meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from mosaiq.operators.components import connected_components, least_labels
from mosaiq.params import DEFAULTS
from mosaiq.tables import freed, written

#: Vectors that one block holds on average.
BLOCK = 4096
#: Centres at most, and vectors that they are chosen from: what the driver and each task hold doesn't grow with the input.
CENTRES, SAMPLE = 2048, 16384
#: Blocks of an input grow up to LARGEST vectors before they are more than MANY, or FEW of more than MANY * BLOCK vectors: a
#: vector goes to each block that it may reach, so what is shuffled grows with their number. CELLS: products that a task
#: computes at once.
MANY, FEW, LARGEST, CELLS = 32, 16, 65536, 1 << 22
#: By which angles are widened against rounding, and cosines.
SLACK, SMALL = 1e-6, 1e-9


def _block_size(count: int, block: int) -> int:
    return max(block, min(LARGEST, -(-count // (MANY if count <= MANY * BLOCK else FEW))))


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _rows(column.combine_chunks())


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(x, axis=1)
    return np.divide(x, lengths[:, None], out=np.zeros_like(x), where=lengths[:, None] > 0), lengths


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


@dataclass
class Blocks:
    """By centre: the greatest angle of its group, least and greatest length there, the number of the group's first
    block, and how many blocks it has: large groups have several, among which they are dealt by a hash, small ones
    share one. Groups of one block are neighbours; cells has the first group, parts the blocks of each such run."""

    centres: np.ndarray
    angle: np.ndarray
    least: np.ndarray
    most: np.ndarray
    first: np.ndarray
    many: np.ndarray
    cells: np.ndarray
    parts: np.ndarray

    def cosines(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the angles of vectors to all centres; and their lengths."""
        unit, lengths = _units(x)
        return unit @ self.centres.T, lengths

    def own(self, ids: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of vectors, and which of the group's blocks."""
        at = cosines.argmax(1)
        mixed = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return at, (mixed % self.many[at].astype(np.uint64)).astype(np.int64)

    def bounds(self, cosines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """By group, at least the dot products of vectors with any vector of it."""
        wide = np.minimum(self.angle + SLACK, np.pi)
        near = cosines * np.cos(wide) + np.sqrt(np.maximum(0, 1 - cosines**2)) * np.sin(wide)
        near = np.where(cosines >= np.cos(wide), 1, near) + SMALL
        return np.where(self.most >= 0, near * lengths[:, None] * np.where(near >= 0, self.most, self.least), -np.inf)

    def by_block(self, values: np.ndarray) -> np.ndarray:
        """The greatest of each block's groups."""
        return np.repeat(np.maximum.reduceat(values, self.cells, axis=1), self.parts, axis=1)


def _means(x: np.ndarray, centres: np.ndarray, steps: int = 5) -> np.ndarray:
    """k-means of unit vectors; centres without any go."""
    for _ in range(steps):
        sums = np.zeros_like(centres)
        np.add.at(sums, (x @ centres.T).argmax(1), x)
        centres, lengths = _units(sums)
        centres = centres[lengths > 0]
    return centres


def _centres(rows: DataFrame, n: int, block: int) -> np.ndarray:
    """Unit vectors amid a sample of the n rows (those of least hash), near ones beside each other."""
    k = min(CENTRES, max(-(-n // block), int(2 * n**0.5)))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 16 * k)).select("embedding").toArrow()["embedding"]
    x, lengths = _units(_matrix(found))
    x = np.unique(x[lengths > 0], axis=0)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    spread = lambda y, m: y[np.linspace(0, len(y) - 1, min(m, len(y))).astype(int)]
    centres = _means(x, spread(x, k))
    regions = _means(centres, spread(centres, int(len(centres) ** 0.5)))
    if not len(regions):
        return np.zeros((1, x.shape[1])) if not len(centres) else centres
    return centres[np.argsort((centres @ regions.T).argmax(1), kind="stable")]


def _blocks(rows: DataFrame, centres: np.ndarray, block: int) -> Blocks:
    """The blocks of the rows around centres; one pass."""
    k = len(centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cosine, least, most = np.zeros(k, np.int64), np.ones(k), np.full(k, np.inf), np.zeros(k)
        for batch in _pieces(batches):
            unit, lengths = _units(_rows(batch.column(1)))
            cosines = unit @ centres.T
            np.add.at(n, cosines.argmax(1), 1)
            # whichever of centres equally near a later pass takes, its group knows of the vector
            row, at = np.nonzero(cosines >= cosines.max(1, keepdims=True) - SMALL)
            np.minimum.at(cosine, at, np.where(lengths[row] > 0, cosines[row, at], 1))
            np.minimum.at(least, at, lengths[row])
            np.maximum.at(most, at, lengths[row])
        some = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (np.arange(k), n, cosine, least, most)], ["g", "n", "cosine", "least", "most"])

    measured = rows.mapInArrow(measure, "g long, n long, cosine double, least double, most double")
    found = measured.groupBy("g").agg(F.sum("n").alias("n"), F.min("cosine").alias("cosine"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
    g = found["g"].to_numpy(np.int64)
    n, cosine, least, most = np.zeros(k, np.int64), np.ones(k), np.zeros(k), np.full(k, -1.0)  # most < 0: an empty group
    n[g], cosine[g], least[g], most[g] = (found[c].to_numpy() for c in ("n", "cosine", "least", "most"))
    many = np.maximum(1, -(-n // block))
    cells, held = [], block + 1
    for i in range(k):
        # a group that fills blocks by itself has a run of its own
        if many[i] > 1 or held + n[i] > block:
            cells.append(i)
            held = 0
        held = block + 1 if many[i] > 1 else held + int(n[i])
    parts = many[cells]
    of_cell = np.searchsorted(cells, np.arange(k), side="right") - 1
    return Blocks(centres, np.arccos(np.clip(cosine, -1, 1)), least, most, (np.cumsum(parts) - parts)[of_cell], many, np.array(cells), parts)


def _sent(rows: DataFrame, blocks: Blocks, reached: Callable) -> DataFrame:
    """rows with own, the block of each, and to, the blocks it goes to; reached gives these as flags, of the batch, its
    cosines and lengths, groups, and which of the groups' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            cosines, lengths = blocks.cosines(_rows(batch.column(1)))
            at, part = blocks.own(batch.column(0).to_numpy(), cosines)
            hit = reached(batch, cosines, lengths, at, part)
            ends = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(hit)[1].astype(np.int32)))
            own = pa.array((blocks.first[at] + part).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, own, to], [*batch.schema.names, "own", "to"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("own", IntegerType()), StructField("to", ArrayType(IntegerType()))]))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").filter("id IS NOT NULL AND embedding IS NOT NULL")


def _block_pairs(vectors: DataFrame, block: int, threshold: float | None = None) -> DataFrame:
    """i <= j, own, id, embedding: each vector in every pair of blocks that its own is part of; if there is a threshold,
    only where the other block may have a vector with at least that dot product."""
    rows = _usable(vectors)
    count = rows.count()
    block = _block_size(count, block)
    n = max(1, -(-count // block))
    if threshold is None or n == 1:
        own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        rows = rows.withColumn("own", own).withColumn("to", F.sequence(F.lit(0), F.lit(n - 1)))
    else:
        blocks = _blocks(rows, _centres(rows, count, block), block)

        def reached(batch: pa.RecordBatch, cosines: np.ndarray, lengths: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
            hit = blocks.by_block(blocks.bounds(cosines, lengths) >= threshold)
            hit[np.arange(len(at)), blocks.first[at] + part] = True
            return hit

        rows = _sent(rows, blocks, reached)
    to = F.transform("to", lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return rows.withColumn("to", F.explode(to)).select("to.i", "to.j", "own", "id", "embedding")


def blocks_met(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """One row: blocks, pairs (of blocks, each with itself among them), met (of them, by pairs_above at that threshold),
    products (of vectors, computed there) and all_products."""
    sides = _block_pairs(vectors, block, threshold).groupBy("i", "j").agg(F.count_if(F.col("own") == F.col("i")).alias("x"), F.count_if(F.col("own") == F.col("j")).alias("y"))
    own = F.col("i") == F.col("j")
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0))
    total = sides.agg(
        F.count_if(own).alias("blocks"),
        F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("met"),
        whole(F.col("x") * F.col("y")).alias("products"),
        whole(F.when(own, F.col("x"))).alias("n"),
        whole(F.when(own, F.col("x") * F.col("x"))).alias("squares"),
    )
    # blocks apart: each pair of vectors once; a block with itself: every ordered pair
    every = (F.col("n") * F.col("n") + F.col("squares")) / 2
    return total.select("blocks", (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long").alias("pairs"), "met", "products", every.cast("long").alias("all_products"))


def _products(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of two blocks: rows of the one, rows of the other, and their dot products in double precision, bit by bit."""
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    x, own = _matrix(t["embedding"]), t["own"].to_numpy()
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    other, step = x[right].T, max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        yield left[at : at + step], right, x[left[at : at + step]] @ other


def _top(sims: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values, to 12 digits, of the k greatest of each row, ties by column. What is below a row's least
    may be missing."""
    if sims.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
    # what rounding makes as great counts, too
    row, column = np.nonzero(sims >= (least - 2e-12)[:, None])
    values = np.round(sims[row, column], 12)
    order = np.lexsort((column, -values, row))
    row, column, values = row[order], column[order], values[order]
    stays = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[stays], column[stays], values[stays]


def pairs_above(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a < b, sim: all pairs of vectors (id, embedding) with dot product >= threshold.

    A task multiplies two blocks and returns the pairs above the threshold."""

    def multiply(t: pa.Table) -> pa.Table:
        ids, same = t["id"].to_numpy(), t["i"][0].as_py() == t["j"][0].as_py()
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for left, right, sims in _products(t):
            u, v = np.nonzero(sims >= threshold)
            first, second = ids[left[u]], ids[right[v]]
            keep = first < second if same else np.ones(len(u), bool)
            a.append(np.minimum(first, second)[keep])
            b.append(np.maximum(first, second)[keep])
            s.append(sims[u, v][keep])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(s)})

    return _block_pairs(vectors, block, threshold).groupBy("i", "j").applyInArrow(multiply, "a long, b long, sim double")


def linked_above(vectors: DataFrame, threshold: float, mixed: float | None = None, block: int = BLOCK) -> DataFrame:
    """u, v: edges with the same connected components as all pairs with dot product >= threshold: of each two blocks
    a forest, however dense the pairs. If `mixed` is given, vectors of negative id link with the others alone, at
    that threshold."""
    return _forests(vectors, [threshold], mixed, block).select("u", "v")


#: Vectors that all others meet before any blocks do, and vectors apart from these that meet all others without blocks.
HUBS, APART = 1024, 8192


def components_above(vectors: DataFrame, threshold: float, mixed: float | None = None, block: int = BLOCK, hubs: int = HUBS, apart: int = APART) -> DataFrame:
    """node, component: connected_components of linked_above.

    Where links are frequent, almost all vectors are linked with one of a few hubs, and what is in one component by these needs
    no more products: only vectors without a link to a hub meet all the others. Where these are more than `apart`, blocks meet."""
    rows = _usable(vectors)
    by_blocks = lambda: connected_components(linked_above(vectors, threshold, mixed, block))
    if rows.count() <= 4 * hubs:
        return by_blocks()
    # clusters, of negative id, are not linked with each other
    chosen = rows if mixed is None else rows.filter("id >= 0")
    found = chosen.orderBy(F.xxhash64("id"), "id").limit(hubs).toArrow().combine_chunks()
    if not found.num_rows:
        return by_blocks()
    centre_ids, centres = found["id"].to_numpy(), _matrix(found["embedding"]).T
    k = len(centre_ids)
    by_id = np.argsort(centre_ids)

    def links(ids: np.ndarray, x: np.ndarray, others: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
        sims = x @ others
        if mixed is None:
            return sims >= threshold
        one, other = (ids < 0)[:, None], (other_ids < 0)[None, :]
        return np.where(one & other, False, sims >= np.where(one | other, mixed, threshold))

    def hub_of(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first hub that each vector is linked with, itself among them, or -1; and all."""
        hit = links(ids, x, centres, centre_ids)
        at = by_id[np.minimum(np.searchsorted(centre_ids, ids, sorter=by_id), k - 1)]
        own = np.flatnonzero(centre_ids[at] == ids)
        hit[own, at[own]] = True
        return np.where(hit.any(1), hit.argmax(1), -1), hit

    def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = labels[a], labels[b]
        differ = a != b
        return least_labels(a[differ], b[differ], len(labels))[labels] if differ.any() else labels

    def edges(labels: np.ndarray, kind: int) -> pa.RecordBatch:
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(moved), kind, np.int32)), pa.array(moved), pa.array(labels[moved].astype(np.int32))], ["kind", "id", "hub"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.arange(k)
        for batch in _pieces(batches):
            ids = batch.column(0).to_numpy()
            hub, hit = hub_of(ids, _rows(batch.column(1)))
            if labels.any():
                row, column = np.nonzero(hit)
                labels = merged(labels, hub[row], column)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(hub.astype(np.int32))], ["kind", "id", "hub"])
        yield edges(labels, 1)

    told = written(rows.mapInArrow(meet, "kind int, id long, hub int"), "hubs")
    of_vectors = told.filter("kind = 0")
    joined = told.filter("kind = 1").toArrow()
    labels = merged(np.arange(k), joined["id"].to_numpy(), joined["hub"].to_numpy())
    groups = of_vectors.groupBy("hub").agg(F.count("*").alias("n"), F.min("id").alias("least")).toArrow().to_pylist()
    without = sum(g["n"] for g in groups if g["hub"] < 0)
    if without > apart:
        freed(told)
        return by_blocks()
    # nodes: hubs, then what is apart from them
    rest = rows.join(F.broadcast(of_vectors.filter("hub < 0").select("id")), "id").select("id", "embedding").toArrow().combine_chunks().sort_by("id")
    rest_ids, total = rest["id"].to_numpy(), k + without
    labels = np.concatenate([labels, np.arange(k, total)])
    if without:
        rest_x = _matrix(rest["embedding"]).T

        def meet_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = labels
            for batch in _pieces(batches):
                ids, x = batch.column(0).to_numpy(), _rows(batch.column(1))
                hub, _ = hub_of(ids, x)
                node = np.where(hub >= 0, hub, k + np.minimum(np.searchsorted(rest_ids, ids), without - 1))
                row, column = np.nonzero(links(ids, x, rest_x, rest_ids))
                mine = merged(mine, node[row], k + column)
            yield edges(mine, 1)

        joined = rows.mapInArrow(meet_rest, "kind int, id long, hub int").toArrow()
        labels = merged(labels, joined["id"].to_numpy(), joined["hub"].to_numpy())
    size, least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    for g in groups:
        if g["hub"] >= 0:
            size[labels[g["hub"]]] += g["n"]
            least[labels[g["hub"]]] = min(least[labels[g["hub"]]], g["least"])
    np.add.at(size, labels[k:], 1)
    np.minimum.at(least, labels[k:], rest_ids)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            node = labels[np.where(hub >= 0, hub, k + np.minimum(np.searchsorted(rest_ids, ids), max(0, without - 1)))] if len(ids) else hub
            some = size[node] > 1  # a vector without links is in no component
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(least[node[some]])], ["node", "component"])

    return of_vectors.select("id", "hub").mapInArrow(name, "node long, component long")


def linked_above_each(vectors: DataFrame, thresholds: Sequence[float], block: int = BLOCK) -> DataFrame:
    """threshold (by its place), u, v: linked_above of each threshold, from the same products."""
    return _forests(vectors, list(thresholds), None, block)


def _forests(vectors: DataFrame, thresholds: list[float], mixed: float | None, block: int) -> DataFrame:
    def forest(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        labels = [np.arange(len(ids)) for _ in thresholds]
        for left, right, sims in _products(t):
            for k, threshold in enumerate(thresholds):
                hit = sims >= threshold
                if mixed is not None:
                    one, other = (ids[left] < 0)[:, None], (ids[right] < 0)[None, :]
                    hit = np.where(one & other, False, np.where(one | other, sims >= mixed, hit))
                u, v = np.nonzero(hit)
                a, b = labels[k][left[u]], labels[k][right[v]]
                if (apart := a != b).any():
                    labels[k] = least_labels(a[apart], b[apart], len(ids))[labels[k]]
        moved = [np.flatnonzero(label != np.arange(len(ids))) for label in labels]
        return pa.table(
            {
                "threshold": np.concatenate([np.full(len(m), k, np.int32) for k, m in enumerate(moved)]),
                "u": np.concatenate([ids[m] for m in moved]),
                "v": np.concatenate([ids[label[m]] for m, label in zip(moved, labels, strict=True)]),
            }
        )

    least = min(thresholds) if mixed is None else min(*thresholds, mixed)
    return _block_pairs(vectors, block, least).groupBy("i", "j").applyInArrow(forest, "threshold int, u long, v long")


def similarity_counts(vectors: DataFrame, bins: int, block: int = BLOCK) -> DataFrame:
    """bin, n, least, most: how many pairs of vectors have a dot product in each of equal bins from -1 to 1, and the
    least and greatest in it; summed in each two blocks before the shuffle."""

    def count(t: pa.Table) -> pa.Table:
        ids, same = t["id"].to_numpy(), t["i"][0].as_py() == t["j"][0].as_py()
        n, least, most = np.zeros(bins, np.int64), np.full(bins, 2.0), np.full(bins, -2.0)
        for left, right, sims in _products(t):
            values = sims[ids[left][:, None] < ids[right][None, :]] if same else sims.ravel()
            at = np.clip(((values + 1) / 2 * bins).astype(np.int64), 0, bins - 1)
            n += np.bincount(at, minlength=bins)
            np.minimum.at(least, at, values)
            np.maximum.at(most, at, values)
        some = np.flatnonzero(n)
        return pa.table({"bin": some, "n": n[some], "least": least[some], "most": most[some]})

    counts = _block_pairs(vectors, block).groupBy("i", "j").applyInArrow(count, "bin long, n long, least double, most double")
    return counts.groupBy("bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, id, sim, rank: the k nearest of the corpus (id, embedding) to each query; ties go to the lower id. If
    there is a floor, only what is at least that near need come back.

    Blocks of queries meet blocks of the corpus; each task returns k rows a query, of which the best k stay. If the
    corpus has several blocks, a query first meets one with its own group; the k-th there bounds what others must reach, blocks
and vectors."""
    c = _usable(corpus)
    count = c.count()
    block = _block_size(count, block)
    lowest = -np.inf if floor is None else floor
    q = _usable(queries).withColumn("bound", F.lit(float(lowest)))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out: list[tuple] = [(none, none, np.zeros(0))]
        if a.num_rows and b.num_rows:
            order = np.argsort(b["id"].to_numpy(), kind="stable")
            ids, y = b["id"].to_numpy()[order], _matrix(b["embedding"])[order].T
            x, mine, bound = _matrix(a["embedding"]), a["id"].to_numpy(), a["bound"].to_numpy()
            step = max(1, CELLS // len(ids))
            for at in range(0, len(x), step):
                row, column, values = _top(x[at : at + step] @ y, k, bound[at : at + step])
                out.append((mine[at + row], ids[column], values))
        return pa.table(dict(zip(("query_id", "id", "sim"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id long, id long, sim double")

    if count <= block:
        nq = max(1, -(-q.count() // block))
        left = q.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("j", F.lit(0))
        found = met(left, c.withColumn("j", F.lit(0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))
    else:
        centres = _centres(c, count, block)
        of_q, of_c = _blocks(q, centres, block), _blocks(c, centres, block)
        # by group and block of its queries: the block of the corpus, of the same group, that these meet first
        group = np.repeat(np.arange(len(centres)), of_q.many)
        turn = np.arange(len(group)) - np.repeat(np.cumsum(of_q.many) - of_q.many, of_q.many)
        meetings = np.unique(np.stack([of_c.first[group] + turn % of_c.many[group], of_q.first[group] + turn]), axis=1)
        n_c, n_q = int(of_c.parts.sum()), int(of_q.parts.sum())

        def first_of_query(batch, cosines, lengths, at, part):
            return (of_c.first[at] + part % of_c.many[at])[:, None] == np.arange(n_c)

        def first_of_other(batch, cosines, lengths, at, part):
            own = of_c.first[at] + part
            hit = np.zeros((len(own), n_q), bool)
            for j in np.unique(own):
                hit[np.ix_(own == j, meetings[1, meetings[0] == j])] = True
            return hit

        sides = lambda left, right: met(
            left.withColumn("j", F.explode("to")).withColumn("i", F.col("own")).select("i", "j", "id", "embedding", "bound"),
            right.withColumn("i", F.explode("to")).withColumn("j", F.col("own")).select("i", "j", "id", "embedding"),
        )
        begun = written(sides(_sent(q, of_q, first_of_query), _sent(c, of_c, first_of_other)), "begun")
        # a query that has met fewer than k has no bound but the floor
        kth = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("kth"))
        known = F.greatest(F.coalesce("kth", F.lit(lowest)), F.lit(lowest))
        bounded = written(q.drop("bound").join(kth, q.id == kth.query_id, "left").select("id", "embedding", known.alias("bound")), "bounded")

        def rest_of_query(batch, cosines, lengths, at, part):
            reach = of_c.by_block(of_c.bounds(cosines, lengths)) >= batch.column(2).to_numpy()[:, None]
            return reach & ~first_of_query(batch, cosines, lengths, at, part)

        left = written(_sent(bounded, of_q, rest_of_query).filter("size(to) > 0"), "queries")
        # of each block of queries the least bound, and only blocks that still have queries
        least = np.full(n_q, np.inf)
        open_blocks = left.groupBy("own").agg(F.min("bound").alias("bound")).toPandas()
        least[open_blocks["own"].to_numpy(np.int64)] = open_blocks["bound"].to_numpy(float)

        def rest_of_other(batch, cosines, lengths, at, part):
            return of_q.by_block(of_q.bounds(cosines, lengths)) >= least

        found = begun.unionByName(sides(left, _sent(c, of_c, rest_of_other)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_match(articles: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """id, cluster_id, sim: of articles (id, embedding), the nearest of centroids (cluster_id, centroid), if near enough."""
    found = nearest(articles, centroids.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding")), 1, threshold)
    return found.filter(F.col("sim") >= threshold).select(F.col("query_id").alias("id"), F.col("id").alias("cluster_id"), "sim")


Encoder = Callable[[Iterator], Iterator]


def hashing_encoder(dimension: int = 384, batch_rows: int = DEFAULTS.vector_batch) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder without a model: hashed words and word pairs, at unit length, in batches of so many rows. Any function
    from (rows, id column, text column) to (id, embedding) can take its place."""

    def encode(rows: DataFrame, key: str, text: str) -> DataFrame:
        import zlib

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, batch_rows) for b in batches for at in range(0, b.num_rows, batch_rows)):
                out = np.zeros((batch.num_rows, dimension), np.float32)
                for i, t in enumerate(batch.column(1).to_pylist()):
                    words = (t or "").lower().split()
                    for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                        h = zlib.crc32(w.encode())
                        out[i, h % dimension] += 1 if h & 0x80000000 else -1
                lengths = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, lengths, out=out, where=lengths > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimension, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "embedding"])

        return rows.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, embedding array<float>")

    return encode
