"""Connected components of a link table: local contraction and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.runtime import written

#: Links that a task contracts at once (16 bytes each); the number of tasks grows with the links.
LINKS_PER_TASK = 1 << 20


def lowest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links and the lowest node it can reach over them."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            u, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in lowest_reachable(u, v)], names=["node", "component"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return run


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _to_lowest(pairs: DataFrame, side: str) -> DataFrame:
    """Link every ``v`` of a node (and the node, on the small side) to the node's lowest neighbour.

    The lowest neighbour comes from an aggregate that combines before the shuffle
    and returns through a join, which AQE can split where a hub is hot.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = pairs.join(low, "u")
    if side == "large":
        return met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))


def components(edges: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``: the lowest node it can reach.

    In each round tasks replace their share of the links, whatever links these are, by stars around
    the lowest nodes; where a node is then in two stars, one pass of alternating stars moves links between tasks.
    All three steps keep what can be reached and never raise a node's lowest neighbour, so rounds end. Each is
    linear in the links and cut off by written tables, so a lost executor only costs a re-read.
    Repeated links are harmless; self links and links with a null end count as none, and no links give no rows.
    """
    edges = written(edges.select("u", "v").where("u <> v"), "links")
    while True:
        tasks = -(-edges.count() // links_per_task)
        stars = written(edges.coalesce(max(1, tasks)).mapInArrow(_contract(links_per_task), "node long, component long"), "links")
        nodes = written(stars.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("last")), "links")
        if nodes.where("component < last").isEmpty():
            return nodes.select("node", "component")
        links = stars.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        large = _to_lowest(_both_ways(links), "large").where("u <> v").distinct()
        edges = written(_to_lowest(large, "small").where("u <> v").distinct(), "links")
