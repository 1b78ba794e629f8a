"""Result rows with all their fields, and the counted predictions of each run, kept by row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecflow.operators import evaluation
from vecflow.plans.datagrid import search_parameters
from vecflow.plans.experiments import GRID_KEYS, run_searches
from vecflow.sources.files import RESULT_FIELDS, union_all

CLASSES = (0, 1, 2, 3)  # classes with a precision of their own in a result row
# Fields that say what was run; they are carried into the row as given.
GIVEN = ("segment_lenght", "segment_overlap", "feature", "vector_operation", "metric_type", "vote_type", "neighbors", "index_params")
KINDS = {
    "segment_lenght": "int", "segment_overlap": "int", "neighbors": "int", "skipped": "boolean", "training_set_size": "bigint",
    "testing_set_size": "bigint", **dict.fromkeys(("feature", "vector_operation", "metric_type", "vote_type", "index_params", "row_key"), "string"),
}
SCHEMA = ", ".join(f"{name} {KINDS.get(name, 'double')}" for name in RESULT_FIELDS)
PAIRS = "row_key string, y int, y_hat int, n bigint"


def run_recorded(train: DataFrame, test: DataFrame, rows: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """(result rows, counted predictions) of grid rows.

    A grid row has ``row_key, metric_type, neighbors, vote_type`` and perhaps the other given fields, ``normalize`` and ``seed``;
    ``index_params`` is the text of :func:`vecflow.plans.datagrid.search_parameters`. A result row has all fields of a result
    and ``message``; elapsed times are those of the shared build and search, used memory is in kilobytes (see
    :func:`vecflow.plans.measure.measured`). A row that can't be run is ``skipped`` with its message and no predictions.
    An unknown key is an error.
    """
    spark = train.sparkSession
    configurations, failed = [], []
    for row in rows:
        if unknown := set(row) - set(GIVEN) - {"row_key", "normalize", "seed"}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        own = {k: v for k, v in row.items() if k in GRID_KEYS}
        try:
            configurations.append({**own, "metric": row["metric_type"], **search_parameters(row.get("index_params"))})
        except ValueError as error:
            failed.append((row["row_key"], str(error)))
    searches, skipped = run_searches(train, test, configurations)
    failed += skipped
    neighbors = {c["row_key"]: c["neighbors"] for c in configurations}
    given = spark.createDataFrame([
        tuple({**row, "neighbors": neighbors.get(row["row_key"], row.get("neighbors"))}.get(name) for name in (*GIVEN, "row_key")) for row in rows
    ], ", ".join(f"{name} {KINDS[name]}" for name in (*GIVEN, "row_key")))
    messages = spark.createDataFrame(failed, "row_key string, message string")
    parts = []
    for search in searches:
        numbers = search.numbers
        fields = {
            "training_set_size": numbers["training_set_size"], "train_elapsed_time": numbers["train_seconds"],
            "predict_elapsed_time": numbers["predict_seconds"], "train_used_memory": numbers["train_memory"],
            "predict_used_memory": numbers["predict_memory"],
        }
        parts.append(evaluation.pair_results(search.pairs, ["row_key"], CLASSES).withColumns({k: F.lit(v) for k, v in fields.items()}))
    empty = spark.createDataFrame([], SCHEMA).drop(*GIVEN, "skipped")
    measures = union_all([empty, *parts])
    # as many rows as the grid has
    results = given.join(F.broadcast(measures), "row_key", "left").join(F.broadcast(messages), "row_key", "left")
    results = results.withColumn("skipped", F.col("message").isNotNull()).select(*RESULT_FIELDS, "message")
    return results, union_all([spark.createDataFrame([], PAIRS), *(s.pairs for s in searches)])


def keep_predictions(pairs: DataFrame, folder: str) -> None:
    """Counted predictions in one folder per row key; a run that is repeated replaces only its own."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("row_key").parquet(folder)


def kept_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The counted predictions of all runs; a filter or join on the row key reads only its folders."""
    return spark.read.schema(PAIRS).parquet(folder)
