"""Top-k of a cross-validation in one search: a block compares fold numbers, so a vector is stored and shipped once.

Every row is a query among the rows of the other folds. The scaler of a fold (fitted on its other folds' rows) is applied
inside the block, to the queries of the fold and to the rows they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.functions.vectors import metric_name
from vecflow.operators.blocks import TopK, matrix
from vecflow.operators.neighbors import (
    ARROW_PART, BROADCAST_BYTES, CELL, CELL_BYTES, CELL_ROWS, PART_SCHEMA, _ids, _labels, _meet, grid_shape, rank_hits, streamed_bytes,
)

Scalers = dict[int, tuple[np.ndarray, np.ndarray]]


def scaled(vectors: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Min-max scaled rows; a constant dimension is 0."""
    if ends is None or not len(vectors):
        return vectors
    low, span = ends[0], ends[1] - ends[0]
    return np.where(span == 0, 0.0, (vectors - low) / np.where(span == 0, 1.0, span))


class MaskedTopK:
    """The k nearest rows of other folds for each row of a query block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, folds: np.ndarray, k: int, metric: str, scalers: Scalers | None):
        self.scalers = scalers
        self.best = {int(f): TopK(ids[folds == f], scaled(vectors[folds == f], self._of(f)), k, metric) for f in np.unique(folds)}

    def _of(self, fold: int):
        return self.scalers[int(fold)] if self.scalers else None

    def add(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> None:
        for fold, best in self.best.items():
            other = folds != fold
            best.add(ids[other], scaled(vectors[other], self._of(fold)), labels[other])

    def batches(self) -> list[pa.RecordBatch]:
        return [best.batch(ARROW_PART) for best in self.best.values()]


def masked_topk(rows: DataFrame, k: int, metric: str = "cosine", scalers: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest rows of other folds for every row of ``(id, vector, label, fold)``, in the form of every search.

    ``scalers`` has ``low`` and ``high`` per fold. A table that fits the broadcast travels to its own partitions; a larger
    one meets itself on the grid of cells, whatever the number of folds.
    """
    metric = metric_name(metric)
    context = rows.sparkSession.sparkContext
    number, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    ends = None
    if scalers is not None:  # a row per fold
        ends = {r["fold"]: (np.array(r["low"], float), np.array(r["high"], float)) for r in scalers.collect()}
    kept = context.broadcast(ends)
    columns = ["id", "vector", "label", "fold"]
    if number and streamed_bytes(number, dim, k) <= broadcast_bytes:
        table = rows.select("id", "vector", "fold").toArrow()
        sent = context.broadcast((_ids(table["id"]), matrix(table["vector"]), _ids(table["fold"])))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = MaskedTopK(*sent.value, k, metric, kept.value)
            for batch in batches:
                if batch.num_rows:
                    best.add(_ids(batch["id"]), matrix(batch["vector"]), _labels(batch["label"]), _ids(batch["fold"]))
            yield from best.batches()

        return rank_hits(rows.select(*columns).mapInArrow(search, PART_SCHEMA), k)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=ARROW_PART)
        best = MaskedTopK(_ids(left["id"]), matrix(left["vector"]), _ids(left["fold"]), k, metric, kept.value)
        for batch in right.to_batches(max_chunksize=4096):
            best.add(_ids(batch["id"]), matrix(batch["vector"]), _labels(batch["label"]), _ids(batch["fold"]))
        return pa.Table.from_batches(best.batches())

    cells = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = grid_shape(number, number, cells, max(1, min(CELL_ROWS, CELL_BYTES // (8 * max(dim or 1, 1)))))
    layout = {"cell": F.lit(0), "q_shards": F.lit(shape[0]), "t_shards": F.lit(shape[1])}
    left, right = _meet(rows.select("id", "vector", "fold").withColumns(layout), rows.select(*columns).withColumns(layout))
    sides = [side.select(*names).toDF(*names).groupBy(*CELL) for side, names in ((left, [*CELL, "id", "vector", "fold"]), (right, [*CELL, *columns]))]
    return rank_hits(sides[0].cogroup(sides[1]).applyInArrow(meet, PART_SCHEMA), k)
