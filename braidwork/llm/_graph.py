"""Connected components of an edge table, without collecting any part of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the edges u-v: each node but the least of its component, with that least."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up
    own = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[own], nodes[parent[own]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the component's least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars. Every step is a
    minimum with partial aggregation and a join, so a node of any degree is spread over tasks.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = checkpoint(least.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
