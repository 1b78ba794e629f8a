"""Boxes in few dimensions: the hits of the other plans, with few rows shipped and few pairs compared."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.operators import boxes, neighbors


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(4).cache()


def hits(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9), r["label"]) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    """Even in three dimensions, one of few values, some far away, with copies."""
    rng = np.random.default_rng(11)
    found = rng.uniform(size=(6_000, 3))
    found[:, 2] = np.round(found[:, 2] * 4) / 4
    found[:300] = found[0]
    found[300:310] *= 1_000
    return found


@pytest.fixture(scope="module")
def sides(spark, points):
    rng = np.random.default_rng(12)
    asked = np.vstack([0.5 + 0.05 * rng.normal(size=(150, 3)), points[:5], [[9.0, -9.0, 50.0], [-1e6, 0.0, 0.0]]])
    return frame(spark, asked), frame(spark, points)


@pytest.mark.parametrize("metric", ["l2", "euclidean", "manhattan"])
def test_same_hits_as_a_stream(sides, metric):
    plain = hits(neighbors.exact_topk(*sides, 7, metric))
    assert hits(neighbors.exact_topk(*sides, 7, metric, box_from=1)) == plain and len(plain) == 7 * 157


@pytest.mark.parametrize("sample", [1_500, 3_000, 10**6])
def test_any_sample_gives_the_same_hits(sides, sample, monkeypatch):
    """Also with boxes cut into shards by rows and pairs."""
    monkeypatch.setattr(boxes.lay_out, "__defaults__", (sample,))
    monkeypatch.setattr(neighbors, "BOX_PAIRS", 3_000)
    queries, rows = sides[0].where("id < 150"), sides[1]
    parts = neighbors._by_boxes(queries, rows, 150, 6_000, 7, "l2", False, 50)
    assert hits(neighbors.rank_hits(parts, 7)) == hits(neighbors.exact_topk(queries, rows, 7, "l2"))


def test_neighbours_of_the_same_table(sides):
    _, rows = sides
    plain = hits(neighbors.exact_topk(rows, rows, 4, "euclidean", skip_same=True))
    assert hits(neighbors.exact_topk(rows, rows, 4, "euclidean", skip_same=True, box_from=1)) == plain


def test_few_rows_are_shipped_and_compared(sides):
    queries, rows = sides
    left, right, counts = boxes.lay_out(queries.where("id < 150"), rows, 150, 6_000, 7, "l2")
    assert right.count() < 6_000 / 10
    met = left.groupBy("cell").count().join(right.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    assert met.agg(F.sum(F.col("count") * F.col("n"))).first()[0] < 150 * 6_000 / 10


def test_a_query_far_from_all_reaches_what_it_needs(points):
    tree = boxes.grow(points, 10)
    rng = np.random.default_rng(13)
    asked = np.vstack([rng.uniform(-1, 2, size=(200, 3)), 1e4 * rng.normal(size=(20, 3))])
    for metric in boxes.METRICS:
        far = boxes._length(asked[:, None] - points[None], metric)
        kth = np.sort(far, axis=1)[:, 4]
        bound = boxes.tightened(tree, asked, boxes.bounds(tree, asked, 5, metric), 5, metric)
        assert (bound >= kth).all() and (bound <= kth * (1 + 1e-8) + 1e-7).all()
        row, box = boxes.reached(tree, asked, kth, metric)
        reached = np.zeros((len(asked), len(tree.axis)), bool)
        reached[row, box] = True
        home = boxes.box_of(tree, points)
        assert reached[:, home][far <= kth[:, None]].all()


def test_where_it_does_not_pay(spark):
    rng = np.random.default_rng(14)
    few = frame(spark, rng.normal(size=(60, 3)))
    assert boxes.lay_out(few, few, 60, 60, 5, "l2") is None
    copies = frame(spark, np.ones((300, 2)))
    assert boxes.lay_out(copies, copies, 300, 300, 5, "l2") is None
    assert hits(neighbors.exact_topk(copies, copies, 5, "l2", box_from=1)) == hits(neighbors.exact_topk(copies, copies, 5, "l2"))


def test_vectors_of_other_sizes_are_an_error(spark, sides):
    with pytest.raises(Exception, match="vectors of different size"):
        neighbors.exact_topk(frame(spark, np.ones((3, 2))), sides[1], 5, "l2", box_from=1).collect()
