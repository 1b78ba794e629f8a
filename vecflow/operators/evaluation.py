"""Evaluation of predictions ``(y, y_hat)``; every table starts from the counted pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def counted_pairs(df: DataFrame, y: str, y_hat: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str, y_hat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions among all ``n`` rows; a missing prediction or truth is a miss."""
    hit = F.coalesce(F.col(y) == F.col(y_hat), F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """Counts for every (true, predicted) pair of the labels met on either side, zeros included.

    The matrix has classes squared cells by definition; rows are reduced to counted
    pairs before anything else.
    """
    pairs = counted_pairs(df, y, y_hat)
    labels = pairs.select(F.explode(F.array("y", "y_hat")).alias("label")).agg(F.collect_set("label").alias("labels"))
    cells = labels.select("labels", F.explode("labels").alias("y")).select("y", F.explode("labels").alias("y_hat"))
    return cells.join(pairs, ["y", "y_hat"], "left").select("y", "y_hat", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, y: str, y_hat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    return pair_report(counted_pairs(df, y, y_hat, keys), keys)


def pair_report(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The class report from counted pairs ``(*keys, y, y_hat, n)``."""
    side = F.explode(
        F.array(
            F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                     F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("y_hat").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).alias("hits")),
        )
    ).alias("side")
    sums = pairs.select(*keys, side).groupBy(*keys, F.col("side.label").alias("label")).agg(
        *[F.sum(f"side.{c}").alias(c) for c in ("support", "predicted", "hits")]
    )
    precision = safe_ratio(F.col("hits"), F.col("predicted"))
    recall = safe_ratio(F.col("hits"), F.col("support"))
    scored = sums.select(*keys, "label", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(*keys, "label", "precision", "recall", f1.alias("f1"), "support")


def nested_matrix(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key ``matrix``: an array of (y, counts), counts being those of every predicted label in ascending order.

    The labels are those met on either side of the key's pairs; queries without a prediction are counted in ``n_missing``. What
    meets in a group is the matrix itself.
    """
    known = pairs.where(F.col("y").isNotNull() & F.col("y_hat").isNotNull())
    met = pairs.select(*keys, F.explode(F.array("y", "y_hat")).alias("label")).where(F.col("label").isNotNull())
    labels = met.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    cells = labels.select(*keys, "labels", F.explode("labels").alias("y")).select(*keys, "y", F.explode("labels").alias("y_hat"))
    filled = cells.join(known, [*keys, "y", "y_hat"], "left").select(*keys, "y", "y_hat", F.coalesce("n", F.lit(0)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("y_hat", "n")))
    lines = filled.groupBy(*keys, "y").agg(F.transform(ordered, lambda c: c["n"]).alias("counts"))
    matrices = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "counts"))).alias("matrix"))
    missing = pairs.groupBy(*keys).agg(F.sum(F.when(F.col("y_hat").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    return missing.join(matrices, list(keys), "left")


def nested_report(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key ``report``: an array of (label, precision, recall, f1, support) in ascending order of the label."""
    rows = pair_report(pairs, keys).where(F.col("label").isNotNull())
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias("report"))


def pair_results(pairs: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Per key accuracy, test size and the precision of each listed class (null when never met); a missing prediction is a miss."""
    hit = F.coalesce(F.col("y") == F.col("y_hat"), F.lit(False))
    sizes = pairs.groupBy(*keys).agg(
        (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("testing_set_size")
    )
    cells = [F.max(F.when(F.col("label") == c, F.col("precision"))).alias(f"precision_{c}") for c in classes]
    if not cells:
        return sizes
    return sizes.join(pair_report(pairs, keys).groupBy(*keys).agg(*cells), list(keys))


def report_with_averages(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """The class report with accuracy, macro and weighted averages as further rows."""
    report = class_report(df, y, y_hat)
    measures = ("precision", "recall", "f1")
    by_class = report.select(F.col("label").cast("string").alias("label"), *measures, "support")
    weight = F.col("support")
    averages = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[safe_ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}") for m in measures],
        F.sum("support").alias("support"),
    )
    rows = [
        F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                 F.col("support").alias("support"))
        for kind in ("macro", "weighted")
    ]
    # recall weighted by support is the share of hits, that is the accuracy
    hit = F.col("weighted_recall")
    rows.append(F.struct(F.lit("accuracy").alias("label"), *[hit.alias(m) for m in measures], F.col("support").alias("support")))
    return by_class.unionByName(averages.select(F.inline(F.array(*rows))))


def describe_classes(report: DataFrame, names: DataFrame, digits: int = 4) -> DataFrame:
    """Report rows with the class number replaced by its description; other rows keep theirs."""
    named = names.select(F.col("label").cast("string").alias("label"), F.col("description"))
    return report.join(F.broadcast(named), "label", "left").select(
        F.coalesce("description", "label").alias("label"),
        *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def flat_result(df: DataFrame, y: str, y_hat: str, classes: Sequence[int]) -> DataFrame:
    """One result row: accuracy, test size and the precision of each listed class (null when never met)."""
    report = class_report(df, y, y_hat)
    cells = [F.max(F.when(F.col("label") == c, F.col("precision"))).alias(f"precision_{c}") for c in classes]
    hits = F.sum(F.col("recall") * F.col("support"))
    return report.agg(
        safe_ratio(hits, F.sum("support")).alias("accuracy"),
        F.sum("support").alias("testing_set_size"),
        *cells,
    ).withColumn("skipped", F.lit(False))


def provenance(df: DataFrame) -> DataFrame:
    """Counters on hits from the query's own file or recording group.

    Input per query: ``y, prediction, first_label, file, group, hit_file, hit_group``,
    where first_label belongs to the nearest hit and hit_* to the last one listed.
    """
    first_right = F.col("first_label") == F.col("y")
    isolated = F.col("hit_group") != F.col("group")
    return df.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("prediction") == F.col("y")).alias("correct"),
        F.count_if(first_right).alias("first_correct"),
        F.count_if(first_right & (F.col("hit_file") == F.col("file"))).alias("same_file"),
        F.count_if(first_right & (F.col("hit_group") == F.col("group"))).alias("same_group"),
        F.count_if(isolated).alias("isolated"),
        F.count_if(first_right & isolated).alias("isolated_correct"),
    ).withColumn("isolated_accuracy", safe_ratio(F.col("isolated_correct"), F.col("isolated")))


def fold_summary(folds: DataFrame, keys: Sequence[str], means: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Averages of measures and sums of times over the folds of a configuration."""
    return folds.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums]
    )
