"""Global ranks, neighbours in sort order and exact percentiles without one big task.

A window without a partition, a window over a few classes and the built-in exact
percentile all gather a group in one task. Here a column is first cut into value
ranges of a bounded number of rows; ranks are ranks inside a range plus the number
of rows in the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.session import shared_dir

ROWS_PER_RANGE = 500_000


def range_bounds(df: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Cut points for ranges of about ``rows_per_range`` rows; none for a small table.

    The cut points only steer the partitioning, so an approximate percentile will do;
    one number per range reaches the driver.
    """
    number = F.col(value).cast("double")
    total = df.select(F.count(number)).first()[0]
    ranges = math.ceil(total / rows_per_range)
    if ranges <= 1:
        return []
    points = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(number, points, max(10_000, 10 * ranges))).first()[0] or []
    return sorted(set(found))


def with_range(df: DataFrame, value: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Number of the value range of each row, by binary search in the JVM."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    cuts = [-math.inf, *bounds, math.inf]
    numeric = f"{out}_number"
    bucketed = Bucketizer(splits=cuts, inputCol=numeric, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(numeric, F.col(value).cast("double"))
    )
    return bucketed.withColumn(out, F.col(out).cast("int")).drop(numeric)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    out: str = "quantiles",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per key with an array.

    A table below ``rows_per_range`` rows uses the built-in aggregate. Beyond that equal
    values are counted first, so copies of a value weigh one row, and the rank is built
    from value ranges, so a hot key is spread over many tasks.
    """
    rows = df.where(F.col(value).isNotNull())
    bounds = range_bounds(rows, value, rows_per_range)
    if not bounds:
        points = F.array(*[F.lit(float(p)) for p in probs])
        return rows.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), points).alias(out))

    counted = rows.groupBy(*keys, F.col(value).cast("double").alias("q_value")).agg(F.count(F.lit(1)).alias("q_count"))
    ranged = with_range(counted, "q_value", bounds, "q_range")
    sizes = ranged.groupBy(*keys, "q_range").agg(F.sum("q_count").alias("q_size"))
    per_key = Window.partitionBy(*keys)
    before = F.sum("q_size").over(per_key.orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        *[F.col(key).alias(f"o_{key}") for key in keys],
        F.col("q_range").alias("o_range"),
        F.coalesce(before, F.lit(0)).alias("q_before"),
        F.sum("q_size").over(per_key).alias("q_total"),
    )
    match = F.col("q_range") == F.col("o_range")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"o_{key}"))
    in_range = Window.partitionBy(*keys, "q_range").orderBy("q_value")
    ranked = ranged.join(offsets, match).withColumn(
        "q_last", F.col("q_before") + F.sum("q_count").over(in_range) - 1
    ).withColumn("q_first", F.col("q_last") - F.col("q_count") + 1)

    def at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("q_first"), F.col("q_last")), F.col("q_value")))

    found, points = [], []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("q_total") - 1)
        found += [
            at(F.floor(position)).alias(f"low_{i}"),
            at(F.ceil(position)).alias(f"high_{i}"),
            F.max(position - F.floor(position)).alias(f"part_{i}"),
        ]
        points.append(F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * F.col(f"part_{i}"))
    return ranked.groupBy(*keys).agg(*found).select(*keys, F.array(*points).alias(out))


def _in_order(df: DataFrame, value: str, tie: str, descending: bool) -> DataFrame:
    """The stored rows in the order (value, tie), nulls first, with ``r_part`` (a range of the order) and ``r_at`` (a place in it).

    Spark's own range partitioning cuts the typed columns, so nulls, texts and numbers of any size keep their order; the
    table is stored because a range must not change between the jobs that read it.
    """
    shared_dir(df.sparkSession)
    first = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    placed = df.orderBy(first, F.col(tie).asc_nulls_first()).withColumn("r_at", F.monotonically_increasing_id()).checkpoint()
    return placed.withColumns({"r_part": F.shiftright("r_at", 33), "r_at": F.col("r_at").bitwiseAND(F.lit((1 << 33) - 1))})


def _small(df: DataFrame, rows_per_range: int) -> bool:
    return df.limit(rows_per_range + 1).count() <= rows_per_range


def _window(value: str, tie: str, descending: bool) -> Window:
    first = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    return Window.orderBy(first, F.col(tie).asc_nulls_first())


# In the functions below a window without a partition only ever sees a table of at most
# rows_per_range rows, or one row per partition of the sorted table.


def with_ordinal(
    df: DataFrame,
    value: str,
    tie: str,
    descending: bool = False,
    out: str = "ordinal",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds the 0-based position of each row in the order (value, tie) of the whole table, nulls first."""
    if _small(df, rows_per_range):
        position = F.row_number().over(_window(value, tie, descending)) - 1
        return df.withColumn(out, position.cast("bigint"))
    ordered = _in_order(df, value, tie, descending)
    sizes = ordered.groupBy("r_part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("r_part", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(offsets), "r_part").withColumn(out, F.col("before") + F.col("r_at")).select(*df.columns, out)


def with_previous(
    df: DataFrame,
    value: str,
    tie: str,
    descending: bool = False,
    out: str = "previous",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds the value of the row before in the order (value, tie), nulls first; null for the first row."""
    if _small(df, rows_per_range):
        return df.withColumn(out, F.lag(value).over(_window(value, tie, descending)))
    ordered = _in_order(df, value, tie, descending)
    last = ordered.groupBy("r_part").agg(F.max_by(F.struct(F.col(value).alias("v")), "r_at").alias("last"))
    carried = last.select("r_part", F.lag("last").over(Window.orderBy("r_part"))["v"].alias("carried"))
    inside = F.lag(value).over(Window.partitionBy("r_part").orderBy("r_at"))
    found = ordered.join(F.broadcast(carried), "r_part").withColumn(out, F.when(F.col("r_at") == 0, F.col("carried")).otherwise(inside))
    return found.select(*df.columns, out)


def drop_unchanged(
    df: DataFrame, value: str, tie: str, descending: bool = True, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Keeps a row of a sorted report only where its score differs from the row before.

    The first row is compared with 0, so a leading score of 0 is dropped too. Rows without a score come first, differ
    from any other and are all kept.
    """
    marked = with_previous(df, value, tie, descending, "previous_score", rows_per_range)
    changed = F.col(value).isNull() | (F.col(value) != F.coalesce(F.col("previous_score"), F.lit(0)))
    return marked.where(changed).drop("previous_score")


def every_nth(
    df: DataFrame, value: str, tie: str, step: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows number 0, step, 2*step, ... in the order (value, tie)."""
    if step < 1:
        raise ValueError("step must be at least 1")
    ordered = with_ordinal(df, value, tie, out="nth", rows_per_range=rows_per_range)
    return ordered.where(F.col("nth") % step == 0)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; planned as TakeOrderedAndProject, so no full sort."""
    return df.orderBy(*order).limit(n)


def latest_by_key(df: DataFrame, key: str, version: Column) -> DataFrame:
    """One row per key, the one with the greatest version.

    An aggregate, not a window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), version).alias("newest"))
        .select(key, *[F.col(f"newest.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def first_valid_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the first non-null value of every other column, in the given order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*firsts)
