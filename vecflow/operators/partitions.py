"""User functions over tables: per row as a column expression, per partition as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

PARTITIONS = 10
PartitionFunction = Callable[[Iterator[pd.DataFrame], int], Iterator[pd.DataFrame]]


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """A row function written as column expressions, evaluated where the rows are."""
    return df.withColumns(columns)


def map_partitions(df: DataFrame, function: PartitionFunction, schema: str | StructType) -> DataFrame:
    """Calls a function once per partition with an iterator over its batches and the partition's number.

    It yields frames as it goes, so a partition is never held whole; what it keeps between batches holds for the whole
    partition, however many batches that has. A partition without rows gives it an empty iterator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from function((batch for batch in batches if len(batch)), TaskContext.get().partitionId())

    return df.mapInPandas(run, schema)


def map_table(df: DataFrame, function: PartitionFunction, schema: str | StructType, partitions: int = PARTITIONS) -> DataFrame:
    """Like :func:`map_partitions` after spreading the rows over a number of partitions."""
    return map_partitions(df.repartition(partitions), function, schema)


def map_records(
    lines: DataFrame, record_schema: str, function: PartitionFunction, schema: str | StructType, partitions: int = PARTITIONS, value: str = "value"
) -> DataFrame:
    """A partition function over records kept as JSON lines; a line that is no JSON object becomes a record of nulls."""
    return map_table(lines.select(F.from_json(value, record_schema).alias("record")).select("record.*"), function, schema, partitions)


MAJORITY_SQL = "vecflow_majority"


def register_majority(spark: SparkSession) -> str:
    """Registers the vote over an array of labels as a SQL function; ties go to the smallest label."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {MAJORITY_SQL}(labels ARRAY<INT>) RETURNS INT
        RETURN array_max(transform(array_distinct(labels),
            l -> struct(size(filter(labels, x -> x = l)) AS votes, -l AS turned, l AS label))).label
    """)
    return MAJORITY_SQL
