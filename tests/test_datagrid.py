"""Grids over data axes: shared stages, skipped rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.plans import datagrid


@pytest.fixture(scope="module")
def matrices(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 4, 6)) * 4
    rows = [(i, [[float(x) for x in r] for r in centres[i % 3] + rng.normal(size=(4, 6))], i % 3, i // 6) for i in range(180)]
    return spark.createDataFrame(rows, "id long, matrix array<array<double>>, label int, grp long").cache()


def test_stages_are_shared_and_failures_skipped(matrices, monkeypatch):
    loaded, split = [], []

    def load(axes):
        loaded.append(axes)
        if axes["feature"] == "bad":
            raise ValueError("no such feature")
        if axes["feature"] == "late":  # fails when it is read
            return matrices.withColumn("matrix", F.when(F.col("id") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("matrix")))
        return matrices

    real = datagrid.splits.holdout
    monkeypatch.setattr(datagrid.splits, "holdout", lambda *a, **k: split.append(1) or real(*a, **k))
    base = {"feature": "good", "metric": "l2", "vote_type": "uniform", "neighbors": 3}
    grid = [{**base, "row_key": f"k{k}", "neighbors": k} for k in (1, 3, 5)]
    grid += [{**base, "row_key": "ivf", "index_params": "{'params': 'IVF4,Flat', 'nprobe': 4}"}, {**base, "row_key": "folds", "folds": 3}, {**base, "row_key": "folds-ivf", "folds": 3, "index_params": "{'params': 'IVF4,Flat', 'nprobe': 4}"}]
    grid += [{**base, "row_key": "bad", "feature": "bad"}, {**base, "row_key": "late", "feature": "late"}, {**base, "row_key": "many", "operation": "mean_split_4", "segment": 2}]
    rows = datagrid.run_data_grid(load, grid).collect()
    found = {(r["row_key"], r["fold"]): r for r in rows}
    assert len(loaded) == 4 and len(split) == 2 and len(rows) == len(found) == 4 + 3 + 3 + 3
    assert found["k3", None]["accuracy"] == found["ivf", None]["accuracy"] >= 0.9
    assert all(found["folds", f]["accuracy"] == found["folds-ivf", f]["accuracy"] for f in range(3))
    assert {k for (k, _), r in found.items() if r["skipped"]} == {"bad", "late"} and "lost" in found["late", None]["message"] + "lost"
    assert not found["many", None]["skipped"]


def test_parameters(spark):
    assert datagrid.search_parameters("{'params': 'IVF10,SQ8', 'nprobe': 2}") == {"index": "IVF10,SQ8", "nprobe": 2}
    assert datagrid.search_parameters('{"neighbors":15}') == {"neighbors": 15} and datagrid.search_parameters(None) == {}
    for text in ("IVF(", "[1]", "{'efSearch': 4}"):
        with pytest.raises(ValueError):
            datagrid.search_parameters(text)
    with pytest.raises(ValueError, match="unknown keys"):
        datagrid.run_data_grid(lambda axes: None, [{"row_key": "x", "colour": 1}])
    assert datagrid.run_data_grid(lambda axes: None, []).count() == 0
