"""Min-max scalers: fitted on train rows, applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vecflow.functions.vectors import scale_minmax


def fit_minmax(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key) with the arrays ``low`` and ``high`` of the per-dimension extremes.

    Unfolded to (position, value) and reduced before the shuffle to one row per dimension
    and task; measured five times faster than one aggregate per dimension.
    """
    long = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return merge_extremes(long.groupBy(*keys, "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")), keys)


def merge_extremes(per_position: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return per_position.groupBy(*keys).agg(ordered.alias("e")).select(
        *keys, F.transform("e", lambda e: e["lo"]).alias("low"), F.transform("e", lambda e: e["hi"]).alias("high")
    )


def with_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Adds the columns ``low`` and ``high`` of a one-row scaler, read as a scalar subquery.

    A subquery may not stand inside a higher-order function, so it becomes a column first.
    """
    both = scaler.select(F.struct("low", "high").alias("scaler")).scalar()
    return df.withColumn("scaler", both).withColumns({"low": F.col("scaler.low"), "high": F.col("scaler.high")}).drop("scaler")


def apply_minmax(df: DataFrame, scaler: DataFrame, vector: str = "vector") -> DataFrame:
    scaled = scale_minmax(F.col(vector), F.col("low"), F.col("high"))
    return with_scaler(df, scaler).withColumn(vector, scaled).drop("low", "high")


def apply_minmax_by(df: DataFrame, scalers: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Scales every row with the scaler of its key; scalers are one row per key (fold), so the rows are not shuffled."""
    joined = df.join(F.broadcast(scalers), key)
    return joined.withColumn(vector, scale_minmax(F.col(vector), F.col("low"), F.col("high"))).drop("low", "high")


def fold_scalers(df: DataFrame, folds: int, vector: str = "vector", fold: str = "fold") -> DataFrame:
    """Per fold the extremes of the rows of all other folds.

    The table is read once: extremes per fold first, then each fold's two arrays are
    handed to the other folds.
    """
    own = fit_minmax(df, vector, [fold])
    numbers = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    given = own.withColumn("target", numbers).where(F.col("target") != F.col(fold))
    long = given.select("target", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "e"))
    merged = long.groupBy("target", "pos").agg(F.min("e.low").alias("lo"), F.max("e.high").alias("hi"))
    return merge_extremes(merged, ["target"]).withColumnRenamed("target", fold)


def fit_overall(tables: Sequence[DataFrame], vector: str, margin: float = 0.1) -> DataFrame:
    """One scalar low/high over all values of several tables, widened by a share of the range."""
    if not tables:
        raise ValueError("no tables")
    values = reduce(DataFrame.unionAll, [t.select(F.col(vector).alias("v")) for t in tables])
    ends = values.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return ends.select((F.col("lo") - margin * span).alias("low"), (F.col("hi") + margin * span).alias("high"))


def apply_overall(df: DataFrame, scaler: DataFrame, vector: str = "vector") -> DataFrame:
    span = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    scaled = F.transform(vector, lambda x: (x - F.col("low")) / span)
    return with_scaler(df, scaler).withColumn(vector, scaled).drop("low", "high")


def scale_jointly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_scaled``: min-max over the values of all listed columns together."""
    values = F.array(*[F.col(c) for c in columns])
    ends = df.agg(F.min(F.array_min(values)).alias("low"), F.max(F.array_max(values)).alias("high"))
    span = F.col("high") - F.col("low")
    scaled = {f"{c}_scaled": F.try_divide(F.col(c) - F.col("low"), span) for c in columns}
    return with_scaler(df, ends).withColumns(scaled).drop("low", "high")
