"""Result rows with all fields, kept predictions, nested reports, measured work."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vecflow.operators import evaluation, reports
from vecflow.plans import records
from vecflow.plans.measure import measured
from vecflow.sources.files import RESULT_FIELDS, append_results


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(i, [float(i % 3) * 5 + (i % 7) / 10, float(i % 5) / 10 + 1], i % 3) for i in range(120)]
    whole = spark.createDataFrame(rows, "id long, vector array<double>, label int").cache()
    return whole.where("id >= 30"), whole.where("id < 30")


PAIRS = [("a", 0, 0, 3), ("a", 0, 1, 1), ("a", 1, 1, 2), ("a", 1, None, 2), ("b", 2, 0, 4), ("c", 0, None, 5)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, records.PAIRS)


def test_matrix_and_report_by_hand(pairs):
    found = {r["row_key"]: r for r in evaluation.nested_matrix(pairs, ["row_key"]).collect()}
    assert [(x["y"], x["counts"]) for x in found["a"]["matrix"]] == [(0, [3, 1]), (1, [0, 2])] and found["a"]["n_missing"] == 2
    assert [(x["y"], x["counts"]) for x in found["b"]["matrix"]] == [(0, [0, 0]), (2, [4, 0])]
    assert [(x["y"], x["counts"]) for x in found["c"]["matrix"]] == [(0, [0])] and found["c"]["n_missing"] == 5
    report = {r["row_key"]: {x["label"]: x for x in r["report"]} for r in evaluation.nested_report(pairs, ["row_key"]).collect()}
    assert report["a"][0]["precision"] == 1 and report["a"][0]["recall"] == 0.75 and report["a"][1]["support"] == 4
    assert report["a"][1]["precision"] == pytest.approx(2 / 3) and report["a"][1]["recall"] == 0.5
    assert report["b"][0]["precision"] == 0 and report["b"][2]["f1"] == 0 and set(report["c"]) == {0}
    rows = {r["row_key"]: r for r in evaluation.pair_results(pairs, ["row_key"], (0, 1, 3)).collect()}
    assert rows["a"]["accuracy"] == 5 / 8 and rows["a"]["testing_set_size"] == 8 and rows["c"]["accuracy"] == 0
    assert rows["a"]["precision_3"] is None and rows["b"]["precision_1"] is None and rows["b"]["precision_0"] == 0


def test_report_of_the_best_rows(spark, pairs):
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.5), ("d", 0.4), ("e", None)], "row_key string, accuracy double")
    found = {r["row_key"]: r for r in reports.detailed_report(rows, pairs, 4).collect()}
    assert set(found) == {"a", "c", "d"}  # b has the score of the row before
    assert len(found["a"]["matrix"]) == len(found["a"]["report"]) == 2 and found["d"]["matrix"] is None
    assert reports.detailed_report(rows.where("false"), pairs, 4).isEmpty()


def test_kept_predictions_are_replaced_by_key(spark, pairs, tmp_path):
    folder = str(tmp_path / "predictions")
    records.keep_predictions(pairs, folder)
    records.keep_predictions(spark.createDataFrame([("b", 1, 1, 7)], records.PAIRS), folder)
    kept = [tuple(r) for r in records.kept_predictions(spark, folder).select("row_key", "y", "y_hat", "n").collect()]
    assert sorted(kept, key=str) == sorted([p for p in PAIRS if p[0] != "b"] + [("b", 1, 1, 7)], key=str)
    plan = records.kept_predictions(spark, folder).where("row_key = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(row_key" in plan


def test_recorded_rows_have_all_fields(spark, sides, tmp_path):
    train, test = sides
    base = {"feature": "f", "metric_type": "l2", "vote_type": "uniform"}
    rows = [
        {**base, "row_key": "flat", "neighbors": 5, "segment_lenght": 2}, {**base, "row_key": "ivf", "index_params": "{'params': 'IVF4,Flat', 'nprobe': 4, 'neighbors': 5}"},
        {**base, "row_key": "text", "neighbors": 5, "index_params": "IVF("}, {**base, "row_key": "metric", "neighbors": 5, "metric_type": "none"},
    ]
    results, pairs = records.run_recorded(train, test, rows)
    found = {r["row_key"]: r for r in results.collect()}
    assert results.columns == [*RESULT_FIELDS, "message"] and len(found) == 4
    assert {k for k, r in found.items() if r["skipped"]} == {"text", "metric"} and all(found[k]["message"] for k in ("text", "metric"))
    assert found["flat"]["accuracy"] == found["ivf"]["accuracy"] == 1 and found["ivf"]["neighbors"] == 5 and found["flat"]["segment_lenght"] == 2
    assert found["flat"]["precision_0"] == 1 and found["flat"]["precision_3"] is None and found["flat"]["testing_set_size"] == 30
    assert found["ivf"]["train_elapsed_time"] > 0 and found["ivf"]["predict_used_memory"] > 0 and found["flat"]["train_used_memory"] == 0
    assert pairs.groupBy("row_key").agg(F.sum("n").alias("n")).where("n = 30").count() == 2
    append_results(results, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError, match="unknown keys"):
        records.run_recorded(train, test, [{**base, "row_key": "x", "neighbors": 1, "colour": 2}])
    nothing, none = records.run_recorded(train, test, [])
    assert nothing.isEmpty() and none.isEmpty()


def test_work_is_measured(spark):
    result, seconds, kilobytes = measured(spark, lambda: spark.range(0, 200_000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).count().collect())
    assert len(result) == 1000 and seconds > 0 and kilobytes > 0
    assert measured(spark, lambda: 7)[0::2] == (7, 0)
    with pytest.raises(ZeroDivisionError):
        measured(spark, lambda: 1 / 0)
    assert not any(t.startswith("vecflow-") for t in spark.sparkContext.getJobTags())
