"""Pivot partitioning for exact neighbour joins: a query only goes to the cells that can hold one of its hits.

Every train row belongs to the cell of its nearest pivot. A cell is known by its rows' number, least and greatest distance
to the pivot and the k least of them. By the triangle inequality these give a query an upper bound on its k-th distance and
a lower bound on its distance to anything in a cell; it is sent to the cells whose lower bound does not exceed the upper
one, so no hit is lost. Cosine and correlation use the chord of unit vectors, whose square is twice the distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.operators.blocks import matrix, prepared, rough
from vecflow.session import shared_dir

MOST_PIVOTS = 4096
CLOSE = 16  # pivots whose rows give a query its upper bound
SLACK = 1e-7  # of a distance computed from a matrix product
ANGULAR = ("cosine", "correlation")
ROWS_AT_ONCE = 512


def usable(metric: str) -> bool:
    """Whether the metric obeys the triangle inequality, as it is or as a chord or root."""
    return metric != "inner_product"


def separation(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """True distances of prepared vectors."""
    found = rough(a, b, metric)
    if metric == "manhattan":
        return found
    return np.sqrt(np.maximum(2.0 * found if metric in ANGULAR else found, 0.0))


def as_bound(distance: np.ndarray, metric: str) -> np.ndarray:
    """The same distance in the terms in which blocks are compared."""
    if metric == "manhattan":
        return distance
    return distance * distance / 2 if metric in ANGULAR else distance * distance


def number_of(n_train: int, dim: int, most_bytes: int) -> int:
    """Pivots for so many rows: about the root, as many as may travel."""
    return max(1, min(MOST_PIVOTS, math.isqrt(n_train), most_bytes // (8 * max(dim, 1))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _zeros(vectors: np.ndarray, metric: str) -> int:
    """Vectors without a direction: their distance is no chord."""
    return int((~vectors.any(axis=1)).sum()) if metric in ANGULAR else 0


def placed(train: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """The checkpointed train rows with ``cell`` (their nearest pivot), ``away`` (its distance) and ``zero``."""
    sent = train.sparkSession.sparkContext.broadcast(prepared(pivots, metric))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            vectors = prepared(matrix(batch["vector"]), metric)
            far = separation(vectors, sent.value, metric)
            cell = far.argmin(axis=1)
            zero = ~vectors.any(axis=1) if metric in ANGULAR else np.zeros(len(cell), bool)
            columns = [batch["id"], batch["vector"], batch["label"], pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), pa.array(zero)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "label", "cell", "away", "zero"])

    shared_dir(train.sparkSession)
    rows = train.select("id", "vector", "label").mapInArrow(place, "id bigint, vector array<double>, label int, cell int, away double, zero boolean")
    return rows.checkpoint()


def cells_of(rows: DataFrame, k: int) -> list:
    """One row per cell: rows, least and greatest distance to the pivot, rows without a direction, the k least distances."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        seen: dict[int, list] = {}
        for batch in batches:
            cell, away, zero = (np.asarray(batch[c].to_numpy(zero_copy_only=False)) for c in ("cell", "away", "zero"))
            for c in np.unique(cell):
                own = away[cell == c]
                n, low, high, zeros = seen.get(c, (0, math.inf, 0.0, 0))
                seen[c] = (n + len(own), min(low, own.min()), max(high, own.max()), zeros + int(zero[cell == c].sum()))
                near[c] = np.sort(np.concatenate([near.get(c, np.zeros(0)), own]))[:k]
        columns = [[int(c) for c in seen], *(list(x) for x in zip(*seen.values()))] if seen else [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        arrays = [pa.array(x, t) for x, t in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([near[c] for c in seen], pa.list_(pa.float64()))], ["cell", "n", "low", "high", "zeros", "near"])

    parts = rows.select("cell", "away", "zero").mapInArrow(sums, "cell int, n long, low double, high double, zeros long, near array<double>")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k numbers per task and cell
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("zeros").alias("zeros"), least.alias("near")).collect()


def asking(queries: DataFrame, pivots: np.ndarray, cells: list, k: int, metric: str) -> DataFrame:
    """The checkpointed queries with the ``cells`` that can hold one of their k hits, and the ``bound`` of the k-th distance."""
    used = np.array([r["cell"] for r in cells])
    near = np.full((len(cells), k), np.inf)
    for i, r in enumerate(cells):
        near[i, : len(r["near"])] = r["near"]
    low, high = np.array([r["low"] for r in cells]), np.array([r["high"] for r in cells])
    sent = queries.sparkSession.sparkContext.broadcast((prepared(pivots, metric)[used], used, near, low, high))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, used, near, low, high = sent.value
        close = min(CLOSE, len(used))
        for batch in _pieces(batches):
            vectors = prepared(matrix(batch["vector"]), metric)
            far = separation(vectors, points, metric)
            some = np.argpartition(far, close - 1, axis=1)[:, :close]
            upper = (np.take_along_axis(far, some, axis=1)[:, :, None] + near[some]).reshape(len(far), -1)
            upper = np.partition(upper, k - 1, axis=1)[:, k - 1]
            own = far.argmin(axis=1)
            nearest = far[np.arange(len(far)), own][:, None]
            lower = np.maximum(far - high, low - far)
            if metric == "manhattan":
                lower = np.maximum(lower, (far - nearest) / 2)
            else:  # a row of another cell lies beyond the plane between the two pivots
                between = separation(points[own], points, metric)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lower = np.fmax(lower, np.where(between > SLACK, (far * far - nearest * nearest) / (2 * between), 0.0))
            slack = SLACK * (1 + far)
            reach = lower <= upper[:, None] + slack
            bound = as_bound(upper + SLACK * (1 + nearest[:, 0]), metric)
            zeros = pa.array(np.full(len(far), _zeros(vectors, metric) > 0))
            columns = [batch["id"], batch["vector"], pa.array([used[r].astype(np.int32) for r in reach], pa.list_(pa.int32())), pa.array(bound), zeros]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "cells", "bound", "zero"])

    rows = queries.select("id", "vector").mapInArrow(ask, "id bigint, vector array<double>, cells array<int>, bound double, zero boolean")
    return rows.checkpoint()


def lay_out(queries: DataFrame, train: DataFrame, k: int, metric: str, skip_same: bool, pivots: int, most_copies: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(queries with cell and bound, train rows with cell, rows of both per cell); None where it would not pay.

    It does not pay when the queries' copies and the train rows reach ``most_copies`` together, and it is not right for
    vectors without a direction under an angular metric: the caller then uses its grid.
    """
    chosen = train.orderBy(F.xxhash64(F.lit(11), F.col("id")), "id").limit(pivots).select("vector").toArrow()
    points = np.unique(matrix(chosen["vector"]), axis=0)
    rows = placed(train, points, metric)
    need = k + 1 if skip_same else k
    cells = cells_of(rows, need)
    if sum(r["zeros"] for r in cells):
        return None
    asked = asking(queries, points, cells, need, metric)
    copies, zeros = asked.agg(F.sum(F.size("cells")), F.max("zero")).first()
    if zeros or copies + sum(r["n"] for r in cells) >= most_copies:
        return None
    counts = queries.sparkSession.createDataFrame([(r["cell"], r["n"]) for r in cells], "cell int, n_train long")
    wanted = asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_query"))
    left = asked.select("id", "vector", "bound", F.explode("cells").alias("cell"))
    return left, rows.select("id", "vector", "label", "cell"), counts.join(F.broadcast(wanted), "cell")
