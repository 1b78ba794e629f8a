"""Pivot partitioning: the hits of the grid, with far fewer rows shipped on clustered vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.operators import neighbors, pivots


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(6)
    centres = 5 * rng.normal(size=(25, 16))
    points = centres[rng.integers(0, 25, 1_500)] + 0.3 * rng.normal(size=(1_500, 16))
    points[:30] = points[0]  # copies
    return frame(spark, points)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9), r["label"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "correlation"])
def test_same_hits_as_the_grid(clustered, metric):
    queries = clustered.where("id % 2 = 0")
    asked = dict(k=6, metric=metric, broadcast_bytes=0)
    grid = hits(neighbors.exact_topk(queries, clustered, **asked))
    parts = neighbors._by_pivots(queries, clustered, 6, metric, False, 38, 10**9, 200)
    assert hits(neighbors.rank_hits(parts, 6)) == grid
    assert hits(neighbors.exact_topk(queries, clustered, **asked, pivot_from=1)) == grid


def test_neighbours_of_the_same_table(clustered):
    grid = hits(neighbors.exact_topk(clustered, clustered, 4, "l2", skip_same=True, broadcast_bytes=0))
    assert hits(neighbors.exact_topk(clustered, clustered, 4, "l2", skip_same=True, broadcast_bytes=0, pivot_from=1)) == grid


def test_few_rows_are_shipped(clustered):
    left, right, counts = pivots.lay_out(clustered, clustered, 5, "cosine", True, 38, 10**9)
    copies = left.count() / clustered.count()
    assert right.count() == clustered.count() and copies < 38 / 5  # the grid would copy to all of them
    assert counts.agg(F.sum("n_train")).first()[0] == clustered.count()


def test_where_it_does_not_pay(spark, clustered):
    rng = np.random.default_rng(7)
    spread = frame(spark, rng.normal(size=(300, 64)))
    assert pivots.lay_out(spread, spread, 5, "cosine", False, 17, 900) is None
    zero = frame(spark, np.vstack([rng.normal(size=(50, 8)), np.zeros((1, 8))]))
    assert pivots.lay_out(zero, zero, 5, "cosine", False, 7, 10**9) is None
    same = hits(neighbors.exact_topk(zero, zero, 5, "cosine", broadcast_bytes=0))
    assert hits(neighbors.exact_topk(zero, zero, 5, "cosine", broadcast_bytes=0, pivot_from=1)) == same
    assert pivots.usable("manhattan") and not pivots.usable("inner_product")


def test_fewer_rows_than_asked_for(spark):
    few = frame(spark, np.random.default_rng(8).normal(size=(5, 4)))
    grid = hits(neighbors.exact_topk(few, few, 9, "euclidean", broadcast_bytes=0))
    parts = neighbors._by_pivots(few, few, 9, "euclidean", False, 2, 10**9, 3)
    assert hits(neighbors.rank_hits(parts, 9)) == grid and len(grid) == 25
