"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from vecflow.llm.common import kept, sized


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the smallest node that each can reach; nodes without an edge are missing.

    Each round first ties all larger neighbours of a node to its smallest one, then all smaller ones; the edges end as
    stars around the smallest node. Every round is stored in the shared folder. The smallest neighbours are aggregates,
    and the edges join them from a stored table, by broadcast up to a counted size and else by a shuffle that can split a
    node with many edges; no node's neighbours are gathered. Nulls are left out.
    """
    stars = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.union(stars.select("b", "a"))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        nodes = least.count()
        large = kept(both.join(sized(least, nodes), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(sized(lower, nodes), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = kept(small.union(lower).distinct())
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each row of a symmetric matrix of links reaches."""
    out, open_ = nodes.copy(), np.ones(len(nodes), bool)
    for i in np.argsort(nodes, kind="stable"):
        if not open_[i]:
            continue
        reached = np.zeros(len(nodes), bool)
        frontier = np.array([i])
        reached[i] = True
        while len(frontier):
            fresh = linked[frontier].any(axis=0) & ~reached
            reached |= fresh
            frontier = np.flatnonzero(fresh)
        out[reached] = nodes[i]
        open_ &= ~reached
    return out
