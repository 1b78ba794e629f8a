"""Cross-validation by a masked search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.operators import folds, neighbors, scaling
from vecflow.plans import experiments


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * [1, 10, 1, 100, 1, 1, 0, 1]
    data = [(i, [float(x) for x in centres[i % 6] + 0.5 * rng.normal(size=8) * [1, 1, 1, 1, 1, 1, 0, 1]], i % 3, (i // 2) % 4) for i in range(240)]
    return spark.createDataFrame(data, "id long, vector array<double>, label int, fold int").repartition(3).cache()


def hits(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9), r["label"]) for r in df.collect())


@pytest.mark.parametrize("limit", [1 << 26, 0])
@pytest.mark.parametrize("normalize", [True, False])
def test_masked_search_equals_a_search_per_fold(rows, limit, normalize):
    expected = []
    for fold in range(4):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if normalize:
            scaler = scaling.fit_minmax(train, "vector")
            train, test = scaling.apply_minmax(train, scaler), scaling.apply_minmax(test, scaler)
        expected += hits(neighbors.exact_topk(test.drop("fold"), train.drop("fold"), 5, "euclidean"))
    scalers = scaling.fold_scalers(rows, 4) if normalize else None
    found = folds.masked_topk(rows, 5, "euclidean", scalers, limit)
    assert hits(found) == sorted(expected)
    assert "Generate" not in folds.masked_topk(rows, 5, "euclidean", scalers)._jdf.queryExecution().executedPlan().toString()


def test_index_at_full_probes_equals_the_exact_folds(rows):
    df = rows.select("id", "vector", "label", F.expr("id div 4").alias("grp"))
    said = lambda **more: sorted(tuple(r) for r in experiments.run_folds(df, "id", "vector", "label", "grp", 3, k=5, metric="l2", **more).collect())
    assert said() == said(index="IVF4,Flat", nprobe=4)


def test_a_failing_search_is_skipped(rows, monkeypatch):
    split = rows.withColumn("train", F.col("fold") > 0)
    train, test = split.where("train").select("id", "vector", "label"), split.where("NOT train").select("id", "vector", "label")
    real = experiments.exact_topk

    def fails(queries, stored, k, metric):
        if metric == "manhattan":
            return real(queries, stored.withColumn("vector", F.slice("vector", 1, 2)), k, metric)  # vectors of different size
        return real(queries, stored, k, metric)

    monkeypatch.setattr(experiments, "exact_topk", fails)
    grid = [{"row_key": m, "metric": m, "neighbors": 3, "vote_type": "uniform"} for m in ("l2", "manhattan")]
    found = {r["row_key"]: r for r in experiments.run_grid(train, test, grid).collect()}
    assert found["manhattan"]["skipped"] and found["manhattan"]["message"] and not found["l2"]["skipped"] and found["l2"]["accuracy"] is not None
