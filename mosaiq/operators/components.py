"""Graphs given as DataFrames of edges: connected components, and first independent nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.tables import freed, written

#: Graphs of so many edges are worked through in one task, with the same result.
SMALL = 20_000


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", small: int = SMALL) -> DataFrame:
    """node, component: the least node that each node of some edge is connected to.

    Each round takes the least label among a node's neighbours and then the label of that label (pointer
    jumping), so long chains close in a logarithm of their length. Every round is written to the shared folder;
    only a count of changed labels reaches the driver. Edges with a null end are ignored. A graph of at most
    `small` edges needs no rounds: one task labels it."""
    pairs = written(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    if pairs.count() <= small:
        return pairs.repartition(1).mapInArrow(_labelled, "node long, component long")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    freed(pairs)
    # the first round needs no join: the least neighbour
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    last = labels
    while True:
        near = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near.hint("merge"), labels.node == near.u, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        to = stepped.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = stepped.join(to.hint("merge"), stepped.label == to.via, "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        jumped = written(jumped, "labels")
        freed(last)
        last, labels = jumped, jumped.drop("old")
        if not jumped.filter("label <> old").limit(1).count():
            freed(both)
            return labels.withColumnRenamed("label", "component")


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of nodes 0 .. n - 1 and edges (a, b): labels fall along the edges, and
    then along themselves, until none does."""
    label = np.arange(n)
    while True:
        old = label.copy()
        least = np.minimum(old[a], old[b])
        # the roots of both ends, too, so that whole trees join
        for at in (a, b, old[a], old[b]):
            np.minimum.at(label, at, least)
        while (label[label] != label).any():
            label = label[label]
        if (label == old).all():
            return label


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of a whole graph."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = least_labels(ends[: len(u)], ends[len(u) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


#: Edges, or rows of keys, that one task decides in order.
COMPONENT = 500_000


def first_independent(edges: DataFrame, cap: int = COMPONENT) -> DataFrame:
    """node: those of the graph's nodes that have no chosen neighbour before them, chosen in the order of the nodes.
    edges: u < v of any type that has an order, each once.

    Up to `cap` edges are decided in one task, along the edges; of more, each connected component of up to so many. So chains
    cost no more jobs than finding components does; only larger components go by rounds. Nodes are told apart by 64-bit
    hashes. Joins are by sorting: a table under the planner's limit on disk may be many times as large in the driver."""
    rows = written(edges.select("u", "v", F.xxhash64("u").alias("hu"), F.xxhash64("v").alias("hv")), "edges")
    n = rows.count()
    if not n:
        return edges.select(F.col("u").alias("node"))
    nodes = rows.select(F.col("u").alias("node"), F.col("hu").alias("h")).unionByName(rows.select(F.col("v").alias("node"), F.col("hv").alias("h"))).distinct()
    if n <= cap:
        chosen = rows.select(F.lit(0).alias("component"), "hu", "hv").repartition(1).mapInArrow(_first_chosen, "h long")
        return nodes.join(chosen.hint("merge"), "h", "left_semi").select("node")
    parts = written(connected_components(rows, "hu", "hv"), "parts")
    placed = rows.select("hu", "hv").join(parts.hint("merge"), rows.hu == parts.node).drop("node")
    giant = written(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > cap).select("component"), "giant")
    small = placed.join(F.broadcast(giant), "component", "left_anti")  # components over the cap: few
    chosen = written(small.select("component", "hu", "hv").repartition("component").mapInArrow(_first_chosen, "h long"), "chosen")
    if giant.limit(1).count():
        more = _by_rounds(placed.join(F.broadcast(giant), "component", "left_semi").select(F.col("hu").alias("u"), F.col("hv").alias("v")))
        chosen = chosen.unionByName(more.withColumnRenamed("node", "h"))
    freed(parts, giant)
    return nodes.join(chosen.hint("merge"), "h", "left_semi").select("node")


def _first_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h of the chosen nodes of whole components, each edge (hu, hv) from an earlier node to a later one: a node is decided
    when all before it are."""
    parts = [(b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    order = np.argsort(a, kind="stable")
    first, later = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist()
    waits, free = np.bincount(b, minlength=len(nodes)).tolist(), [True] * len(nodes)
    ready = [i for i, n in enumerate(waits) if n == 0]
    while ready:
        i = ready.pop()
        for j in later[first[i] : first[i + 1]]:
            if free[i]:
                free[j] = False
            waits[j] -= 1
            if waits[j] == 0:
                ready.append(j)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[np.array(free, bool)])], ["h"])


def _by_rounds(edges: DataFrame) -> DataFrame:
    """first_independent of a graph of any size: a node without undecided nodes before it is chosen, and its later
    neighbours go, and so on. What is chosen stays one table, so plans don't grow with the rounds."""
    left = written(edges.select("u", "v"), "left")
    chosen: DataFrame | None = None
    ends = F.explode(F.array("u", "v")).alias("node")
    while left.limit(1).count():
        later = left.select(F.col("v").alias("node")).distinct()
        first = written(left.select(F.col("u").alias("node")).distinct().join(later.hint("merge"), "node", "left_anti"), "first")
        gone = written(left.join(first.hint("merge"), left.u == first.node, "left_semi").select(F.col("v").alias("node")).distinct(), "gone")
        # what is left: edges between undecided nodes; undecided nodes without such edges are chosen
        rest = written(left.join(gone.hint("merge"), left.u == gone.node, "left_anti").join(gone.hint("merge"), F.col("v") == gone.node, "left_anti"), "left")
        alone = left.select(ends).distinct().join(gone.hint("merge"), "node", "left_anti").join(first.hint("merge"), "node", "left_anti")
        more = first.unionByName(alone.join(rest.select(ends).hint("merge"), "node", "left_anti"))
        every = written(more if chosen is None else chosen.unionByName(more), "chosen")
        freed(left, first, gone, *([] if chosen is None else [chosen]))
        chosen, left = every, rest
    freed(left)
    return chosen
