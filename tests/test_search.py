"""Nearest neighbours against brute force, votes, indexes and whole experiments."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.functions.vectors import prepare
from vecflow.operators import evaluation, indexes, neighbors, splits, votes
from vecflow.plans import experiments

METRICS = ["cosine", "correlation", "l2", "euclidean", "manhattan", "inner_product"]


def table(spark, matrix, labels=None, first=0):
    rows = [(first + i, [float(x) for x in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(5)


def brute(queries, train, k, metric):
    def centred(m):
        return m - m.mean(axis=1, keepdims=True) if metric == "correlation" else m

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    q, t = centred(queries), centred(train)
    if metric in ("cosine", "correlation"):
        d = 1 - unit(q) @ unit(t).T
    elif metric == "inner_product":
        d = -q @ t.T
    elif metric == "manhattan":
        d = np.abs(q[:, None] - t[None]).sum(axis=2)
    else:
        d = ((q[:, None] - t[None]) ** 2).sum(axis=2)
        d = np.sqrt(d) if metric == "euclidean" else d
    order = np.lexsort((np.broadcast_to(np.arange(len(t)), d.shape), np.round(d, 9)))[:, :k]
    return {(i, r + 1): (order[i, r], d[i, order[i, r]]) for i in range(len(q)) for r in range(min(k, len(t)))}


def listed(hits):
    return {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in hits.collect()}


def same(found, expected):
    assert found.keys() == expected.keys()
    for key, (near, dist) in expected.items():
        assert found[key][0] == near and found[key][1] == pytest.approx(dist, abs=1e-9), key


@pytest.fixture(scope="module")
def copies(spark):
    """300 train rows of which a third are copies of one vector, 40 queries, small whole numbers (many ties)."""
    rng = np.random.default_rng(3)
    train = rng.integers(0, 6, size=(300, 5)).astype(float)
    train[::3] = train[0]
    queries = rng.integers(0, 6, size=(40, 5)).astype(float)
    queries[0] = train[0]
    return queries, train, table(spark, queries), table(spark, train, np.arange(300) % 4)


@pytest.mark.parametrize("metric", METRICS)
def test_exact_search_with_copies(copies, metric):
    queries, train, q, t = copies
    expected = brute(queries, train, 7, metric)
    if metric in ("l2", "manhattan", "inner_product"):  # whole numbers: ties are exact
        same(listed(neighbors.exact_topk(q, t, 7, metric)), expected)
    plain = listed(neighbors.exact_topk(q, t, 7, metric))
    grid = listed(neighbors.exact_topk(q, t, 7, metric, broadcast_bytes=0))
    seeded = listed(neighbors.exact_topk(q, t, 7, metric, seed_from=10))
    both = listed(neighbors.exact_topk(q, t, 7, metric, broadcast_bytes=0, seed_from=10))
    assert plain == grid == seeded == both
    assert [round(plain[k][1], 9) for k in sorted(plain)] == pytest.approx([round(expected[k][1], 9) for k in sorted(expected)], abs=1e-9)


def test_search_does_not_depend_on_partitions(copies):
    _, _, q, t = copies
    assert listed(neighbors.exact_topk(q, t.repartition(1), 5)) == listed(neighbors.exact_topk(q, t.repartition(31), 5))


def test_fewer_rows_than_k_and_self(spark, copies):
    _, _, q, t = copies
    few = t.where("id < 4")
    assert neighbors.exact_topk(q, few, 9).groupBy("query_id").count().select("count").distinct().collect()[0][0] == 4
    own = neighbors.exact_topk(few, few, 9, "l2", skip_same=True)
    assert own.where("query_id = neighbor_id").isEmpty() and own.count() == 12
    assert neighbors.exact_topk(q, t.where("id < 0"), 3).isEmpty()
    with pytest.raises(ValueError):
        neighbors.exact_topk(q, t, 0)


def test_grid_keeps_cells_bounded():
    for n_queries, n_train in [(10, 10**9), (10**6, 10**6), (10**7, 10**9)]:
        q, t = neighbors.grid_shape(n_queries, n_train, 200)
        assert n_queries / q <= neighbors.CELL_ROWS and n_train / t <= neighbors.CELL_ROWS
        assert n_queries * n_train / (q * t) <= neighbors.CELL_PAIRS * 1.5


def test_hot_cell_is_cut(spark, copies):
    queries, train, q, t = copies
    one_cell = lambda df: df.withColumn("cell", F.lit(1))
    expected = brute(queries, train, 7, "l2")
    same(listed(neighbors.keyed_topk(one_cell(q), one_cell(t), 7, "l2", cell_rows=17, broadcast_bytes=0)), expected)
    same(listed(neighbors.keyed_topk(one_cell(q), one_cell(t), 7, "l2")), expected)


def test_cells_limit_the_search(copies):
    _, _, q, t = copies
    asked = q.withColumn("cell", F.explode(F.array(F.col("id") % 3, F.lit(3))))
    held = t.withColumn("cell", F.col("id") % 4)
    streamed = neighbors.keyed_topk(asked, held, 7, "l2")
    met = neighbors.keyed_topk(asked, held, 7, "l2", cell_rows=11, broadcast_bytes=0)
    assert listed(streamed) == listed(met)
    assert streamed.where("neighbor_id % 4 <> 3 AND neighbor_id % 4 <> query_id % 3").isEmpty()


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, neighbor_id long, distance double, label int")


def test_votes(spark):
    pick = lambda df: df.first()["prediction"]
    tie = hits_of(spark, [(1, i + 1, i, 0.1 * i, l) for i, l in enumerate([3, 0, 0, 3])])
    assert pick(votes.majority(tie)) == 0 and votes.majority(tie).first()["score"] == 0.5
    near = hits_of(spark, [(1, 1, 1, 0.0, 1), (1, 2, 2, 1.0, 2), (1, 3, 3, 1.0, 2)])
    assert pick(votes.weighted(near)) == 1 and pick(votes.weighted(near, "inverse")) == 1
    ranks = hits_of(spark, [(1, i + 1, i, 0.1, l) for i, l in enumerate([2, 1, 1, 2, 2])])
    found = votes.reciprocal_rank(ranks).first()
    assert found["prediction"] == 2 and found["score"] == pytest.approx(1.45)
    zero = hits_of(spark, [(1, 1, 1, 0.1, 0), (1, 2, 2, 0.2, 1)])
    assert pick(votes.reciprocal_rank(zero)) == 0  # label 0 counts like any other
    with pytest.raises(ValueError):
        votes.predict(tie, "loudest")


def test_validity(spark):
    train = table(spark, [[0, 0], [0, 0.1], [0, 0.2], [0, 0.3]], [1, 1, 1, 2])
    scores = {r["id"]: r["validity"] for r in votes.validity(train, 3, "l2").collect()}
    assert scores[0] == pytest.approx(2 / 3) and scores[3] == 0
    hits = hits_of(spark, [(1, 1, 10, 0.1, 5), (1, 2, 11, 0.2, 4), (1, 3, 12, 0.3, 4)])
    given = spark.createDataFrame([(10, 0.9), (11, 0.5), (12, 0.7)], "id long, validity double")
    assert votes.with_validity(hits, given, 0.6).first()["prediction"] == 5
    assert votes.with_validity(hits, given, 0.95).first()["prediction"] == 4


def test_one_vs_rest(spark):
    rows = [(1, 1, 1, 0.2, 3), (1, 2, 2, 0.2, 3), (1, 3, 3, 0.2, 1), (2, 1, 4, 0.1, 1), (2, 2, 5, 0.2, 2), (2, 3, 6, 0.3, 0)]
    found = {r["query_id"]: (r["prediction"], r["yes_classes"]) for r in votes.one_vs_rest(hits_of(spark, rows), 3).collect()}
    assert found == {1: (3, 1), 2: (0, 0)}


def test_metrics(spark):
    pairs = [(0, 0)] * 49 + [(0, 1)] * 9 + [(1, 0)] * 299 + [(1, 1)] * 42
    df = spark.createDataFrame(pairs, "y int, p int")
    matrix = {(r["y"], r["y_hat"]): r["n"] for r in evaluation.confusion(df, "y", "p").collect()}
    assert matrix == {(0, 0): 49, (0, 1): 9, (1, 0): 299, (1, 1): 42}
    report = {r["label"]: r for r in evaluation.class_report(df, "y", "p").collect()}
    assert report[0]["precision"] == pytest.approx(49 / 348) and report[0]["recall"] == pytest.approx(49 / 58)
    assert evaluation.accuracy(df, "y", "p").first()["accuracy"] == pytest.approx(91 / 399)
    lonely = spark.createDataFrame([(0, 1)], "y int, p int")
    assert {(r["precision"], r["recall"], r["f1"]) for r in evaluation.class_report(lonely, "y", "p").collect()} == {(0, 0, 0)}


# ---------------------------------------------------------------- indexes


@pytest.fixture(scope="module")
def sides(spark, folder):
    from vecflow.catalog.registry import Tables, embedded

    train, test = experiments.train_and_test(embedded(Tables(spark, folder)), "vec_id", "v", "label")
    exact = {(r["query_id"], r["neighbor_id"]) for r in neighbors.exact_topk(test, train, 15).collect()}
    return train, test, exact


def recall(hits, exact):
    return len({(r["query_id"], r["neighbor_id"]) for r in hits.collect()} & exact) / len(exact)


@pytest.mark.parametrize("spec,floor", [("SQ8", 0.95), ("SQfp16", 0.95), ("IVF8,SQ8", 0.95), ("IVF8,Flat", 1.0)])
def test_index_recall(sides, spec, floor):
    train, test, exact = sides
    index = indexes.build_index(train, spec)
    assert recall(indexes.search_index(index, test, 15, nprobe=8), exact) >= floor


def test_recall_rises_with_probes(sides):
    train, test, exact = sides
    index = indexes.build_index(train, "IVF16,Flat")
    found = [recall(indexes.search_index(index, test, 15, nprobe=n), exact) for n in (1, 4, 16)]
    assert found == sorted(found) and found[-1] == 1.0


def test_product_quantisation(sides):
    train, test, exact = sides
    coarse = recall(indexes.search_index(indexes.build_index(train, "PQ4", nbits=3), test, 15), exact)
    fine = recall(indexes.search_index(indexes.build_index(train, "PQ16", nbits=6), test, 15), exact)
    assert fine > coarse and fine >= 0.4
    with pytest.raises(ValueError, match="do not divide"):
        indexes.build_index(train, "PQ10")
    with pytest.raises(ValueError, match="codebook"):
        indexes.build_index(train, "PQ8", nbits=12)


@pytest.mark.parametrize("spec, metric", [("PQ8x4", "cosine"), ("IVF6,PQ4x5", "cosine"), ("IVF6,PQ8x4", "l2"), ("PQ4x4", "manhattan"), ("IVF4,PQ4x4", "inner_product")])
@pytest.mark.parametrize("streamed", [True, False])
def test_distances_of_codes_are_looked_up(sides, spec, metric, streamed, monkeypatch):
    """Hits equal a search over the vectors that codes, codebooks and centres stand for."""
    train, test, _ = sides
    index = indexes.build_index(train, spec, metric)
    rows = index.rows.collect()
    near, ids = [], np.array([r["id"] for r in rows])
    for r in rows:
        vector = np.hstack([index.codebooks[j][c] for j, c in enumerate(r["vector"])])
        near.append(vector + np.array(index.centres[r["cell"]]) if index.centres else vector)
    near = np.array(near)
    if not streamed:
        monkeypatch.setattr(neighbors.keyed_topk, "__defaults__", (None, 50, False, 0))
        monkeypatch.setattr(neighbors.exact_topk, "__defaults__", ("cosine", False, 0, neighbors.SEED_FROM, None, neighbors.PIVOT_FROM))
    hits = collections.defaultdict(list)
    for r in sorted(indexes.search_index(index, test, 7, nprobe=6).collect(), key=lambda r: r["rank"]):
        hits[r["query_id"]].append((r["neighbor_id"], r["distance"]))
    for q in test.select("id", prepare(F.col("vector"), metric).alias("v")).collect():
        v = np.array(q["v"])
        far = {"cosine": 1 - near @ v, "inner_product": -(near @ v), "manhattan": np.abs(near - v).sum(axis=1), "l2": ((near - v) ** 2).sum(axis=1)}[metric]
        of = dict(zip(ids.tolist(), far))
        assert [d for _, d in hits[q["id"]]] == pytest.approx(sorted(far)[:7])
        assert all(of[n] == pytest.approx(d) for n, d in hits[q["id"]])


def test_codebooks_get_closer_by_rounds(sides, monkeypatch):
    """The error of the codes after eight rounds is below that after one."""
    train, _, _ = sides
    error = {}
    for rounds in (1, 8):
        monkeypatch.setattr(indexes, "ROUNDS", rounds)
        rows = train.select("id", "vector")
        books = [np.array(b) for b in indexes.fit_codebooks(rows, 8, 4, rows.count(), 42)]
        vectors = np.array([r["vector"] for r in rows.collect()])
        width = vectors.shape[1] // 8
        error[rounds] = sum(((vectors[:, None, j * width : (j + 1) * width] - books[j][None]) ** 2).sum(axis=2).min(axis=1).sum() for j in range(8))
    assert error[8] < error[1]


def test_probed_cells_are_pruned(sides):
    train, test, exact = sides
    index = indexes.build_index(train, "IVF8,Flat")
    one = test.limit(1).cache()
    hits = indexes.search_index(index, one, 5, nprobe=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    read = {f.split("cell=")[1].split("/")[0] for f in index.rows.where(F.col("cell") == 3).inputFiles()}
    assert "3" in read
    cell_of = {r["id"]: r["cell"] for r in index.rows.select("id", "cell").collect()}
    assert len({cell_of[r["neighbor_id"]] for r in hits.collect()}) == 1


def test_hits_of_probed_cells_have_exact_distances(sides):
    """Whatever the data: every hit lies in a probed cell, and it is among the best of those cells."""
    train, test, _ = sides
    index = indexes.build_index(train, "IVF8,Flat")
    probed = {r["id"]: set(r["probes"]) for r in indexes.with_centres(test.select("id", prepare(F.col("vector"), "cosine").alias("vector")), index.centres, 3).collect()}
    cell_of = {r["id"]: r["cell"] for r in index.rows.select("id", "cell").collect()}
    everything = {(r["query_id"], r["neighbor_id"]): r["distance"] for r in neighbors.exact_topk(test, train, train.count()).collect()}
    found = indexes.search_index(index, test, 5, nprobe=3).collect()
    for r in found:
        assert cell_of[r["neighbor_id"]] in probed[r["query_id"]]
        assert abs(r["distance"] - everything[r["query_id"], r["neighbor_id"]]) < 1e-9
    for q, cells in probed.items():
        best = sorted((d, n) for (i, n), d in everything.items() if i == q and cell_of[n] in cells)[:5]
        assert [n for _, n in best] == [r["neighbor_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]


def test_codes_fit_their_type(sides):
    assert indexes.code_type(1 << 15)[0] == "smallint" and indexes.code_type(1 << 16)[0] == "int"
    books = [np.arange(40_001, dtype=float)[:, None]]
    assert indexes.product_coder(books)(np.array([[40_000.0]])).tolist() == [[40_000]]
    with pytest.raises(ValueError, match="1 to 24 bits"):
        indexes.build_index(sides[0], "PQ4", nbits=25)


def test_no_number_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0])], "id long, v array<double>")
    table = neighbors.as_vectors(rows, "id", "v")
    with pytest.raises(Exception, match="not a finite number"):
        neighbors.exact_topk(table, table, 1).collect()


def test_validity_in_an_index_with_all_cells(sides):
    train, _, _ = sides
    index = indexes.build_index(train, "IVF8,Flat")
    exact = votes.validity(train, 5)
    found = votes.validity(train, 5, search=lambda q, k: indexes.search_index(index, q, k, nprobe=8))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_saved_index(spark, sides, tmp_path):
    train, test, _ = sides
    first = indexes.cached_index(train, "IVF8,SQ8", "cosine", str(tmp_path), "a")
    again = indexes.cached_index(train.where("id < 0"), "IVF8,SQ8", "cosine", str(tmp_path), "a")  # not rebuilt
    assert listed(indexes.search_index(first, test, 5, nprobe=3)) == listed(indexes.search_index(again, test, 5, nprobe=3))


@pytest.mark.parametrize("text", ["IVF8,XX", "LSH", "IVF8,IVF8,Flat", "PQ", "HNSW50,Flat", "IVF0,Flat"])
def test_unknown_index(text):
    with pytest.raises(ValueError, match="unknown index"):
        indexes.parse_spec(text)


def test_too_many_cells(sides):
    with pytest.raises(ValueError, match="centres"):
        indexes.build_index(sides[0], "IVF4000,Flat")


# ---------------------------------------------------------------- experiments


@pytest.fixture(scope="module")
def clusters(spark):
    """Four separated classes, 20 recording groups per class."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        label = i % 4
        vector = rng.normal(0, 0.1, 8) + np.eye(8)[label]
        rows.append((i, [float(x) for x in vector], label, f"g{i // 4 % 20}"))
    return spark.createDataFrame(rows, "id long, v array<double>, label int, grp string").cache()


@pytest.mark.parametrize("index", ["Flat", "SQ8", "IVF4,Flat", "PQ4"])
def test_separated_classes_are_found(clusters, index):
    flagged = splits.holdout(clusters, "label", "grp", keep=True)
    train, test = experiments.train_and_test(flagged, "id", "v", "label")
    predicted = experiments.classify(train, test, "cosine", 5, index=index, nbits=4, nprobe=2)
    assert evaluation.accuracy(predicted, "y", "y_hat").first()["accuracy"] >= 0.99


def test_folds_and_rounds(clusters):
    found = experiments.run_folds(clusters, "id", "v", "label", "grp", 4, k=5)
    rows = found.collect()
    assert len(rows) == 4 and all(r["accuracy"] >= 0.99 for r in rows)
    assert sum(r["testing_set_size"] for r in rows) == 400
    repeated = experiments.repeat_rounds(lambda r: found, 2).groupBy("fold").agg(F.count_distinct("accuracy").alias("n"))
    assert {r["n"] for r in repeated.collect()} == {1}


def test_grid_equals_single_runs(clusters):
    flagged = splits.holdout(clusters, "label", "grp", keep=True)
    train, test = experiments.train_and_test(flagged, "id", "v", "label")
    configurations = [
        {"row_key": f"{m}-{v}-{k}", "metric": m, "vote_type": v, "neighbors": k}
        for m in ("l2", "hamming") for v in ("uniform", "distance") for k in (3, 60)
    ]
    found = {r["row_key"]: r for r in experiments.run_grid(train, test, configurations).collect()}
    assert len(found) == 8
    for c in configurations:
        row = found[c["row_key"]]
        if c["metric"] == "hamming":
            assert row["skipped"] and "unknown metric" in row["message"]
        else:
            single = experiments.classify(train, test, c["metric"], c["neighbors"], c["vote_type"])
            assert row["accuracy"] == evaluation.accuracy(single, "y", "y_hat").first()["accuracy"]


def test_grid_with_indexes_and_rows_that_fail(clusters):
    flagged = splits.holdout(clusters, "label", "grp", keep=True)
    train, test = experiments.train_and_test(flagged, "id", "v", "label")
    base = {"metric": "cosine", "neighbors": 5, "vote_type": "uniform"}
    rows = [
        {**base, "row_key": "flat"}, {**base, "row_key": "all", "index": "IVF4,Flat", "nprobe": 4}, {**base, "row_key": "one", "index": "IVF4,Flat"},
        {**base, "row_key": "sq", "index": "SQ8"}, {**base, "row_key": "cells", "index": "IVF9999,Flat"}, {**base, "row_key": "vote", "vote_type": "nope"},
        {**base, "row_key": "k", "neighbors": 0}, {**base, "row_key": "graph", "index": "HNSW8,Flat"},
    ]
    found = {r["row_key"]: r for r in experiments.run_grid(train, test, rows).collect()}
    assert {k for k, r in found.items() if r["skipped"]} == {"cells", "vote", "k", "graph"} and all(found[k]["message"] for k in ("cells", "vote", "k", "graph"))
    assert found["all"]["accuracy"] == found["flat"]["accuracy"] and found["all"]["n"] == test.count()
    assert found["all"]["train_seconds"] == found["one"]["train_seconds"] > 0 and found["flat"]["training_set_size"] == train.count()
    with pytest.raises(ValueError, match="unknown keys"):
        experiments.run_grid(train, test, [{**base, "row_key": "x", "index_params": "IVF4,Flat"}])


def test_rows_without_label_stay_without(spark, copies):
    _, _, q, t = copies
    bare = neighbors.as_vectors(t, "id", "vector")
    assert neighbors.exact_topk(q, bare, 2).where("label IS NOT NULL").isEmpty()
