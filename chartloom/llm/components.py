"""Connected components by alternating large-star and small-star steps over a table of edges.

Each step joins edges with the least neighbour of a node, so a hub's edges can be split over tasks, and is
written to the shared folder. A table of at most FEW edges, counted first, takes one task instead of these rounds.
Edges of null ends must not occur; an empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c


FEW = 1 << 18


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1, of the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[least_labels(at[: len(u)], at[len(u) :], len(nodes))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u long, v long); root is the least node of its component."""
    now = c.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_at_once, "node long, root long")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = c.stored(large, "large-star")
        m = _least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        after = c.stored(small.where("u <> v").distinct(), "small-star")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        c.release(now)
        c.release(large)
        now = after
        if seen == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = seen
