"""Analysis of result rows: best configurations, groups, shares, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.operators.evaluation import nested_matrix, nested_report
from vecflow.operators.ranking import top_n

# Order of a result report when the caller gives none (fixed values).
REPORT_ORDER = [("accuracy", False), ("feature", True), ("vector_operation", True)]


def sorted_results(
    df: DataFrame, order: Sequence[tuple[str, bool]] = REPORT_ORDER, required: str = "accuracy"
) -> DataFrame:
    """Rows with a result, sorted by (column, ascending) pairs."""
    columns = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    return df.dropna(subset=[required]).orderBy(*columns)


def best_configurations(df: DataFrame, n: int, measure: str, tie: str) -> DataFrame:
    return top_n(df.dropna(subset=[measure]), n, F.col(measure).desc(), F.col(tie))


def value_shares(df: DataFrame, field: str, measure: str, tie: str, n_top1: int, n_top2: int) -> DataFrame:
    """Counts and shares of a field's values, null left out, among all rows and the two best subsets."""
    valid = df.dropna(subset=[measure])
    chosen = valid.select(field, measure, tie)
    best2 = top_n(chosen, n_top2, F.col(measure).desc(), F.col(tie))
    best1 = top_n(chosen, n_top1, F.col(measure).desc(), F.col(tie))

    def counted(rows: DataFrame, subset: str) -> DataFrame:
        return rows.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("subset", F.lit(subset))

    counts = counted(chosen, "all").unionByName(counted(best2, "top2")).unionByName(counted(best1, "top1"))
    # one row per value and subset is left here
    totals = counts.groupBy("subset").agg(F.sum("n").alias("total"), F.max_by("value", F.struct("n", "value")).alias("most_frequent"))
    return counts.join(F.broadcast(totals), "subset").select(
        "subset", "value", "n", (F.col("n") / F.col("total")).alias("share"),
        (F.col("value") == F.col("most_frequent")).cast("int").alias("is_most_frequent"),
    )


def two_level_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts per (outer, inner), nulls left out, and totals per outer; a total has a null inner value."""
    rolled = df.dropna(subset=[outer, inner]).rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return rolled.where(F.col("level") < 3).select(outer, inner, "n", (F.col("level") > 0).cast("int").alias("is_total"))


AGGREGATES = {"min": F.min, "mean": F.avg, "max": F.max}


def group_measures(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Min, mean and max of each measure per group as ``<measure>_<name>``; null groups are dropped."""
    cells = [f(m).alias(f"{m}_{n}") for m in measures for n, f in AGGREGATES.items()]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*cells)


def result_statistics(df: DataFrame, measure: str, tie: str, n_top1: int, n_top2: int) -> DataFrame:
    """Count, max, mean and min overall, and mean and min of the two best subsets, as one row."""
    valid = df.dropna(subset=[measure]).select(measure, tie)
    value = F.col(measure)
    overall = valid.agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.min(value).alias("min")
    )
    for name, n in (("top1", n_top1), ("top2", n_top2)):
        best = top_n(valid, n, value.desc(), F.col(tie))
        part = best.agg(F.struct(F.avg(value).alias("mean"), F.min(value).alias("min")).alias("s")).scalar()
        overall = overall.withColumn("s", part).withColumns(
            {f"mean_{name}": F.col("s.mean"), f"min_{name}": F.col("s.min")}
        ).drop("s")
    return overall


def measure_means(df: DataFrame, group: str, measures: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of the measures for each listed group value."""
    return df.where(F.col(group).isin(*values)).groupBy(group).agg(*[F.avg(m).alias(f"{m}_mean") for m in measures])


def distinct_scores_report(df: DataFrame, n: int, measure: str, ties: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Of the n best rows, ties in order of ``ties``, those whose score differs from the row before.

    The first row is compared with 0. Only the n best rows meet in one task.
    """
    best = top_n(df.dropna(subset=[measure]).drop(*drop), n, F.col(measure).desc(), *map(F.col, ties))
    before = F.lag(measure).over(Window.orderBy(F.col(measure).desc(), *map(F.col, ties)))
    changed = ~F.col(measure).eqNullSafe(F.coalesce(before, F.lit(0)))
    return best.withColumn("changed", changed).where("changed").drop("changed")


def detailed_report(
    df: DataFrame, pairs: DataFrame, n: int, measure: str = "accuracy", ties: Sequence[str] = ("row_key",), key: str = "row_key"
) -> DataFrame:
    """The rows of :func:`distinct_scores_report`, each with its confusion matrix and class report as nested arrays.

    ``pairs`` holds the counted predictions ``(key, y, y_hat, n)`` of all runs; only those of the rows reported (at most ``n``
    keys) are read further. A run without predictions has null arrays.
    """
    best = distinct_scores_report(df, n, measure, ties)
    chosen = pairs.join(F.broadcast(best.select(key)), key, "left_semi")
    return best.join(nested_matrix(chosen, [key]), key, "left").join(nested_report(chosen, [key]), key, "left")


def fixed_text(value: Column, digits: int) -> Column:
    """The number with a fixed count of decimals (at most 4), correctly rounded.

    ``format_string`` rounds the shortest decimal form, which turns 40.595 (stored just
    below) into 40.60; here the stored value decides: its fraction in units of 2^-49 is
    scaled by integer arithmetic, ties go to the even digit.
    """
    if not 0 < digits <= 4:
        raise ValueError("digits must be 1 to 4")
    unit, power = 2**49, 10**digits
    size = F.abs(value)
    whole = F.floor(size)
    steps = (size - whole) * float(unit)
    scaled = F.floor(steps) * F.lit(power).cast("bigint")
    cut = F.shiftright(scaled, 49)
    finer = (steps - F.floor(steps)) * float(power)  # what lies below 2^-49
    rest = scaled.bitwiseAND(F.lit(unit - 1).cast("bigint")) + F.floor(finer)
    beyond_half = (finer > F.floor(finer)) | (cut % 2 == 1)
    up = (rest > unit // 2) | ((rest == unit // 2) & beyond_half)
    rounded = cut + up.cast("bigint")
    carried = rounded == power
    digits_text = F.format_string(f"%0{digits}d", F.when(carried, F.lit(0)).otherwise(rounded).cast("bigint"))
    text = F.concat((whole + carried.cast("bigint")).cast("string"), F.lit("."), digits_text)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def percent_text(value: Column) -> Column:
    return F.concat(fixed_text(value * 100, 2), F.lit("%"))
