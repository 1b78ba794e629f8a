"""Boxes for exact neighbour joins in few dimensions: a query only goes to the boxes that its k-th distance can reach.

A sample of the train rows gives a tree of half-spaces, whose leaves are boxes that fill the space, and every query an upper
bound on its k-th distance: the k-th in the sample. A query is sent to the boxes no further away than
that, so no hit is lost. In one pass the train rows find their box; a row outside of what the queries of its box can reach is
not shipped. The sample decides how even the boxes are and how tight the bounds, never which hits are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.operators.blocks import matrix
from vecflow.session import shared_dir

METRICS = ("l2", "euclidean", "manhattan")
MOST_DIM = 6  # in more dimensions a query reaches most boxes
SAMPLE = 200_000
LEAF = 24  # sampled rows of a box
AROUND = 64  # times k: sampled rows that give a query its first bound
SLACK = 1e-9
ROWS_AT_ONCE = 64
MOST_COPIES = 64  # boxes a query may go to on average


@dataclass(frozen=True)
class Tree:
    """Half-spaces in heap order (children of i: 2i + 1 and 2i + 2); a sampled row above the split lies to the right."""

    axis: np.ndarray  # -1 where a node is a box
    split: np.ndarray
    low: np.ndarray  # ends of the node's part of the space, infinite at the rim
    high: np.ndarray
    first: np.ndarray  # the node's sampled rows are points[first:last]
    last: np.ndarray
    points: np.ndarray


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over a sample, cut at the median of the widest dimension until a node has ``leaf`` rows or only copies."""
    depth = max(0, int(np.ceil(np.log2(max(len(points), 1) / leaf))))
    size, dim = 2 ** (depth + 1) - 1, points.shape[1]
    axis, split = np.full(size, -1), np.zeros(size)
    low, high = np.full((size, dim), -np.inf), np.full((size, dim), np.inf)
    first, last = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    points = points.copy()
    last[0] = len(points)
    for node in range(size // 2):
        own = points[first[node] : last[node]]
        if len(own) <= leaf:
            continue
        spread = own.max(axis=0) - own.min(axis=0)
        d = int(spread.argmax())
        if spread[d] == 0:
            continue
        values = own[:, d]
        cut = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
        if cut == values.max():
            cut = values[values < cut].max()
        right = values > cut
        points[first[node] : last[node]] = np.concatenate([own[~right], own[right]])
        axis[node], split[node] = d, cut
        middle = last[node] - int(right.sum())
        for child, ends in ((2 * node + 1, (first[node], middle)), (2 * node + 2, (middle, last[node]))):
            first[child], last[child] = ends
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1, d] = low[2 * node + 2, d] = cut
    return Tree(axis, split, low, high, first, last, points)


def box_of(tree: Tree, vectors: np.ndarray, enough: int = 0) -> np.ndarray:
    """The box each vector lies in, or the last node on the way to it that has ``enough`` sampled rows."""
    node = np.zeros(len(vectors), dtype=np.int64)
    going = np.arange(len(vectors))
    while len(going):
        at = node[going]
        inner = tree.axis[at] >= 0
        going, at = going[inner], at[inner]
        child = 2 * at + 1 + (vectors[going, tree.axis[at]] > tree.split[at])
        held = tree.last[child] - tree.first[child] >= enough
        going, child = going[held], child[held]
        node[going] = child
    return node


def _length(gaps: np.ndarray, metric: str) -> np.ndarray:
    """Distance in the terms in which blocks are compared."""
    return np.abs(gaps).sum(axis=-1) if metric == "manhattan" else (gaps * gaps).sum(axis=-1)


def bounds(tree: Tree, vectors: np.ndarray, k: int, metric: str) -> np.ndarray:
    """No less than the k-th distance of each vector in the sample: the k-th among the sampled rows in the node around it."""
    found = np.empty(len(vectors))
    node = box_of(tree, vectors, min(AROUND * k, len(tree.points)))
    for n in np.unique(node):
        rows = np.flatnonzero(node == n)
        near = tree.points[tree.first[n] : tree.last[n]]
        step = max(1, 2_000_000 // max(1, near.size))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            far = _length(vectors[some][:, None] - near[None], metric)
            found[some] = np.partition(far, k - 1, axis=1)[:, k - 1]
    return _wider(found, vectors)


def _wider(found: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Bounds with room for rounding."""
    return found * (1 + SLACK) + 1e-12 * (1 + np.abs(vectors).max(initial=0))


def tightened(tree: Tree, vectors: np.ndarray, bound: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The k-th distance in the whole sample, which lies in the boxes that the bound reaches."""
    row, box = reached(tree, vectors, bound, metric)
    order = np.argsort(row, kind="stable")
    box, n = box[order], (tree.last - tree.first)[box[order]]
    ends = np.searchsorted(row[order], np.arange(len(vectors) + 1))
    found = np.empty(len(vectors))
    for r in range(len(vectors)):
        own = slice(ends[r], ends[r + 1])
        many = n[own]
        point = np.repeat(tree.first[box[own]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        found[r] = np.partition(_length(vectors[r] - tree.points[point], metric), k - 1)[k - 1]
    return _wider(found, vectors)


def reached(tree: Tree, vectors: np.ndarray, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of all boxes no further away than the bound."""
    row, node, found = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64), []
    while len(row):
        gap = np.maximum(np.maximum(tree.low[node] - vectors[row], vectors[row] - tree.high[node]), 0.0)
        near = _length(gap, metric) <= bound[row]
        row, node = row[near], node[near]
        box = tree.axis[node] < 0
        found.append((row[box], node[box]))
        row, node = np.repeat(row[~box], 2), np.repeat(2 * node[~box] + 1, 2)
        node[1::2] += 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (row, node)


def asking(queries: DataFrame, tree: Tree, k: int, metric: str) -> DataFrame:
    """The checkpointed queries with the ``cells`` that can hold one of their k hits, and the ``bound`` of the k-th distance."""
    sent = queries.sparkSession.sparkContext.broadcast(tree)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                vectors = _checked(part, tree)
                bound = tightened(tree, vectors, bounds(tree, vectors, k, metric), k, metric)
                row, box = reached(tree, vectors, bound, metric)
                ends = np.searchsorted(np.sort(row), np.arange(len(vectors) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(box[np.argsort(row, kind="stable")].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part["id"], part["vector"], cells, pa.array(bound)], ["id", "vector", "cells", "bound"])

    shared_dir(queries.sparkSession)
    return queries.select("id", "vector").mapInArrow(ask, "id bigint, vector array<double>, cells array<int>, bound double").checkpoint()


def _checked(batch: pa.RecordBatch, tree: Tree) -> np.ndarray:
    vectors = matrix(batch["vector"])
    if len(vectors) and vectors.shape[1] != tree.points.shape[1]:
        raise ValueError("vectors of different size")
    return vectors


def placed(train: DataFrame, tree: Tree, reach: dict[int, tuple]) -> DataFrame:
    """Train rows with the ``cell`` they lie in, those that no query can reach left out; ``reach`` has the ends of what is asked per cell."""
    dim = tree.points.shape[1]
    low, high = np.full((len(tree.axis), dim), np.inf), np.full((len(tree.axis), dim), -np.inf)
    for cell, (least, most) in reach.items():
        low[cell], high[cell] = least, most
    sent = train.sparkSession.sparkContext.broadcast((tree, low, high))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, low, high = sent.value
        for batch in batches:
            if batch.num_rows:
                vectors = _checked(batch, tree)
                cell = box_of(tree, vectors)
                rows = pa.array(np.flatnonzero(((vectors >= low[cell]) & (vectors <= high[cell])).all(axis=1)))
                columns = [batch[c].take(rows) for c in ("id", "vector", "label")] + [pa.array(cell.astype(np.int32)).take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "label", "cell"])

    return train.select("id", "vector", "label").mapInArrow(place, "id bigint, vector array<double>, label int, cell int")


def lay_out(queries: DataFrame, train: DataFrame, n_queries: int, n_train: int, k: int, metric: str, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(queries with cell and bound, train rows with cell, rows of both per cell); None where it would not pay.

    The number of train rows of a cell is estimated by its sampled ones.
    """
    every = max(1, n_train // sample)
    seeds = train.where(F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(every)) == 0).select("vector").toArrow()
    points = matrix(seeds["vector"])
    if len(points) < k:
        return None
    tree = grow(points)
    asked = asking(queries, tree, k, metric)
    dim = points.shape[1]
    radius = F.col("bound") if metric == "manhattan" else F.sqrt("bound")
    ends = [f(F.get("vector", F.lit(d)) + s * radius * (1 + SLACK)).alias(f"{n}{d}") for d in range(dim) for f, s, n in ((F.min, -1, "low"), (F.max, 1, "high"))]
    cells = asked.withColumn("cell", F.explode("cells")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # a row per box
    held = {r["cell"]: int(tree.last[r["cell"]] - tree.first[r["cell"]]) * every for r in cells}
    copies, pairs = sum(r["n"] for r in cells), sum(r["n"] * held[r["cell"]] for r in cells)
    if 4 * pairs > n_queries * n_train or copies > max(n_train, MOST_COPIES * n_queries):
        return None
    reach = {r["cell"]: ([r[f"low{d}"] for d in range(dim)], [r[f"high{d}"] for d in range(dim)]) for r in cells}
    counts = queries.sparkSession.createDataFrame([(r["cell"], r["n"], held[r["cell"]]) for r in cells], "cell int, n_query long, n_train long")
    left = asked.select("id", "vector", "bound", F.explode("cells").alias("cell"))
    return left, placed(train, tree, reach), counts
