"""File sources and sinks: typed CSV, listings, arrays, result logs, JSON documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Columns of the sub-segment table with their narrow types; times are int, as a byte ends at 127.
SEGMENT_SCHEMA = (
    "file_name_prefix string, segment_file string, queen_presence tinyint, queen_acceptance tinyint, "
    "queen_status tinyint, segment_no tinyint, sub_segment_name string, sub_segment_no tinyint, "
    "start_time int, end_time int, train1 tinyint, train2 tinyint"
)

# Columns of a result row, in order (fixed values).
RESULT_FIELDS = [
    "segment_lenght", "segment_overlap", "feature", "vector_operation", "metric_type", "vote_type",
    "neighbors", "index_params", "skipped", "accuracy", "precision_0", "precision_1", "precision_2",
    "precision_3", "training_set_size", "testing_set_size", "train_elapsed_time", "predict_elapsed_time",
    "train_used_memory", "predict_used_memory", "row_key",
]


def snake_case(df: DataFrame) -> DataFrame:
    """Column names with spaces to underscores, in lower case."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | StructType, timestamp_format: str | None = None
) -> DataFrame:
    """CSV with a header and a declared schema; a line that does not fit it fails the job."""
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": True}
    if timestamp_format:
        options["timestampFormat"] = timestamp_format
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def list_files(spark: SparkSession, folder: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """Names and sizes of the files of a folder; the content column is pruned, so nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select(file_name(F.col("path")).alias("name"), "length", "path")
    return named.where(F.col("name").startswith(prefix)) if prefix else named


def write_segments(df: DataFrame, path: str) -> None:
    """Sub-segment table laid out by segment length and overlap."""
    df.write.mode("overwrite").partitionBy("seg_len", "overlap").parquet(path)


def available_overlaps(segments: DataFrame, seg_len: int) -> DataFrame:
    """Overlaps at hand for a segment length; a non-numeric overlap is left out.

    On the partition columns alone, so it is answered from the folder names.
    """
    number = F.col("overlap").cast("string").try_cast("int")
    return segments.where(F.col("seg_len") == seg_len).select(number.alias("overlap")).where("overlap IS NOT NULL").distinct()


def all_overlaps(segments: DataFrame, seg_len: int, overlap: int | str) -> DataFrame:
    """Rows of one overlap, or of every overlap for ``all`` - a partition filter, not a union."""
    rows = segments.where(F.col("seg_len") == seg_len)
    return rows if overlap == "all" else rows.where(F.col("overlap") == overlap)


def concat_csvs(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> tuple[DataFrame, list[str]]:
    """Rows of all readable CSV files, missing columns as null, and messages on the others."""
    if not paths:
        raise ValueError("empty list")
    tables, messages = [], []
    for path in paths:
        try:
            reader = spark.read.option("header", True)
            table = (reader.schema(schema) if schema else reader).csv(path)
            table.schema
            tables.append(table)
        except PySparkException as error:
            messages.append(f"{path}: {error.getCondition() or type(error).__name__}")
    if not tables:
        raise ValueError("no file could be read")
    return union_all(tables), messages


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def append_results(df: DataFrame, path: str) -> None:
    """Appends the successful result rows in the fixed column order."""
    df.where(~F.col("skipped")).select(*RESULT_FIELDS).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str, key: str = "row_key") -> None:
    """One JSON line per run below a folder per key; a run replaces only its own folder."""
    rows = df.select(F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"), key)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def read_document(spark: SparkSession, path: str, value: str, schema: str, key: str = "row_key") -> DataFrame:
    rows = spark.read.schema(f"value string, {key} string").text(path).where(F.col(key) == value)
    return rows.select(key, F.from_json("value", schema).alias("d")).select(key, "d.*")
