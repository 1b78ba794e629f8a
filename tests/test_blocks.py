"""Blocks in small numbers: which pairs they rule out, and the same hits as in doubles."""

from __future__ import annotations

import numpy as np
import pytest

from vecflow.operators import blocks, neighbors

SMALL = ["manhattan", "cosine", "correlation", "inner_product"]


def sets():
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(10, 24))
    mixed = centres[rng.integers(0, 10, 3_000)] + 0.3 * rng.normal(size=(3_000, 24))
    yield "mixed", mixed
    copies = mixed.copy()
    copies[::2] = copies[0]
    yield "copies", copies
    yield "far from zero", 1e6 + mixed
    outlier = mixed.copy()
    outlier[7] *= 1e5
    yield "outlier", outlier
    yield "whole", rng.integers(0, 3, size=(3_000, 24)).astype(float)
    yield "tiny", 1e-150 * mixed
    yield "huge", 1e150 * mixed
    yield "wide", rng.normal(size=(400, 1_200))
    zeros = mixed.copy()
    zeros[::5] = 0
    yield "zeros", zeros
    yield "one value", np.full((300, 3), 0.1)


SETS = dict(sets())


def search(vectors, metric, small: bool, skip: bool, rows=700):
    asked = vectors[:60]
    best = blocks.TopK(np.arange(len(asked)), asked, 9, metric, skip)
    if not small:
        best.misses = blocks.MOST_MISSES + 1
    for at in range(0, len(vectors), rows):
        some = vectors[at : at + rows]
        best.add(np.arange(at, at + len(some)), some, np.arange(at, at + len(some)) % 5)
    return best.near.tolist(), best.dist.tolist(), best.label.tolist()


@pytest.mark.parametrize("metric", SMALL)
@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("skip", [False, True])
def test_same_hits_in_small_numbers(name, metric, skip):
    assert search(SETS[name], metric, True, skip) == search(SETS[name], metric, False, skip)


@pytest.mark.parametrize("metric", SMALL)
@pytest.mark.parametrize("name", SETS)
def test_small_numbers_know_how_far_they_are_off(name, metric):
    vectors = blocks.prepared(SETS[name][:300], metric)
    query, train = vectors[:50], vectors[40:]
    block = blocks.Steps(train, query.min(axis=0), query.max(axis=0)) if metric == "manhattan" else blocks.Products(train, metric)
    if not block.holds(np.sqrt((query * query).sum(axis=1).max())):
        assert name in ("huge", "wide")
        return
    scores, off = block.scores(query)
    true = np.array([blocks.pairwise(np.repeat(q[None], len(train), axis=0), train, metric) for q in query])
    rounding = 1e-12 * max(1.0, 4 * (vectors * vectors).sum(axis=1).max(), np.abs(vectors).max() * vectors.shape[1])
    assert (np.abs(block.base + block.scale * scores.astype(float) - true) <= block.scale * off[:, None] + rounding).all()


@pytest.mark.parametrize("metric", SMALL)
def test_doubles_are_only_for_pairs_that_may_be_hits(metric, monkeypatch):
    expected = search(SETS["mixed"], metric, False, False)
    compared, pairwise = [], blocks.pairwise
    monkeypatch.setattr(blocks, "pairwise", lambda a, b, metric: compared.append(len(a)) or pairwise(a, b, metric))
    monkeypatch.setattr(blocks, "rough", None)  # all pairs in doubles
    assert search(SETS["mixed"], metric, True, False) == expected
    assert sum(compared) < 60 * 3_000 / 10


def test_small_numbers_are_given_up_where_they_tell_little():
    vectors = SETS["far from zero"]
    best = blocks.TopK(np.arange(60), vectors[:60], 9, "inner_product")
    for at in range(0, 3_000, 100):
        best.add(np.arange(at, at + 100), vectors[at : at + 100], np.zeros(100, dtype=int))
    assert best.misses == blocks.MOST_MISSES + 1


@pytest.mark.parametrize("metric", ["inner_product", "l2", "manhattan"])
@pytest.mark.parametrize("centres", [False, True])
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e25])
def test_codes_looked_up_at_once_give_the_same_hits(metric, centres, scale, monkeypatch):
    """With copies (ties), bounds of the caller, and rows that are left out."""
    rng = np.random.default_rng(22)
    books = [scale * rng.normal(size=(n, 6)) for n in (16, 9, 16, 2)]
    codes = np.stack([rng.integers(0, len(b), 2_000) for b in books], axis=1).astype(float)
    codes[::3] = codes[0]
    asked = scale * rng.normal(size=(50, 24))

    def found(bound):
        best = blocks.CodeTopK(np.arange(50), asked, 7, metric, blocks.ProductCodes(books, scale * rng_centres if centres else None), True, bound)
        for at in range(0, 2_000, 600):
            some = codes[at : at + 600]
            best.add(np.arange(at, at + len(some)), some, np.arange(at, at + len(some)) % 5, None, 1)
        return best.near.tolist(), best.dist.tolist(), best.label.tolist()

    rng_centres = np.random.default_rng(23).normal(size=(3, 24))
    free = found(None)
    bounds = np.array(free[1])[:, 4]
    once = free, found(bounds)
    monkeypatch.setattr(blocks, "MOST_ENTRIES", 0)
    assert once == (found(None), found(bounds))


def test_codes_are_looked_up_one_by_one_only_where_they_may_be_hits(monkeypatch):
    rng = np.random.default_rng(24)
    books = [rng.normal(size=(16, 6)) for _ in range(4)]
    codes = rng.integers(0, 16, size=(2_000, 4)).astype(float)
    best = blocks.CodeTopK(np.arange(50), rng.normal(size=(50, 24)), 7, "l2", blocks.ProductCodes(books))
    monkeypatch.setattr(blocks.CodeTopK, "_summed", None)  # all pairs part by part
    best.add(np.arange(2_000), codes, np.zeros(2_000, dtype=int))
    assert np.isfinite(best.dist).all()


def test_quality_searches_once(spark, folder, monkeypatch):
    """The exact hits serve all indexes, and a search is not run again for each of its readers."""
    from vecflow.catalog import QUERIES, search
    from vecflow.operators import indexes

    calls, exact = [], neighbors.exact_topk
    monkeypatch.setattr(search.neighbors, "exact_topk", lambda *a, **b: calls.append("exact") or exact(*a, **b))
    searched = indexes.search_index
    monkeypatch.setattr(search.indexes, "search_index", lambda *a, **b: calls.append("index") or searched(*a, **b))
    found = QUERIES["k15_index_quality"](spark, folder)
    assert calls == ["exact"] + ["index"] * 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroupsInArrow" not in plan
    assert sorted((r["spec"], r["bad_lists"], r["close"]) for r in found.collect()) == [("IVF16,Flat", 0, 1), ("IVF8,PQ4", 0, 1), ("PQ8", 0, 1)]


def test_cells_follow_the_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        assert neighbors.cells_wanted(spark) == neighbors.CELLS_PER_CORE * spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert neighbors.cells_wanted(spark) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
