"""Train/test splits that keep every group of a class on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.functions.joins import null_safe_join
from vecflow.session import shared_dir

HASH_DIGITS = 3  # 4096 hash ranges per class bound the rows of one window task


def group_hash(group: Column, seed: int) -> Column:
    """Null groups are one group, with a hash of its own."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}_"), group.cast("string")), F.lit(f"{seed}")).cast("binary"))


def ranked_groups(df: DataFrame, label: str, group: str, seed: int) -> DataFrame:
    """Distinct (label, group) with its 1-based rank in hash order, and the class size.

    A class may hold billions of groups, so the rank is the rank inside a hash range
    plus the groups in the ranges before; no task sees a whole class.
    """
    groups = (
        df.select(label, group)
        .distinct()
        .withColumn("g_hash", group_hash(F.col(group), seed))
        .withColumn("g_range", F.substring("g_hash", 1, HASH_DIGITS))
    )
    sizes = groups.groupBy(label, "g_range").agg(F.count(F.lit(1)).alias("g_size"))
    per_class = Window.partitionBy(label)
    before = F.sum("g_size").over(per_class.orderBy("g_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        label,
        "g_range",
        F.coalesce(before, F.lit(0)).alias("g_before"),
        F.sum("g_size").over(per_class).alias("class_groups"),
    )
    inside = F.row_number().over(Window.partitionBy(label, "g_range").orderBy("g_hash", group))
    return (
        null_safe_join(groups.withColumn("g_inside", inside), offsets, [label, "g_range"])
        .select(label, group, (F.col("g_before") + F.col("g_inside")).alias("g_rank"), "class_groups")
    )


def flag_members(df: DataFrame, chosen: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Adds ``flag`` = 1 where the key columns, nulls included, occur in ``chosen``, else 0."""
    marked = chosen.select(*keys, F.lit(1).alias(flag))
    return null_safe_join(df.drop(flag), marked, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def _ranked(df: DataFrame, label: str, group: str, seed: int, keep: bool) -> DataFrame:
    ranked = ranked_groups(df, label, group, seed)
    if not keep:
        return ranked
    shared_dir(df.sparkSession)
    return ranked.checkpoint()


def holdout(
    df: DataFrame, label: str, group: str, seed: int = 42, flag: str = "train1", keep: bool = False
) -> DataFrame:
    """In each class a fifth of the groups (rounded up) is test, the others are train; null is a class or group like any.

    ``keep`` checkpoints the ranked groups (not the rows), for a split that several jobs read.
    """
    ranked = _ranked(df, label, group, seed, keep)
    chosen = ranked.where(F.col("g_rank") > F.expr("(class_groups + 4) div 5"))
    return flag_members(df, chosen, [label, group], flag)


def balanced_holdout(df: DataFrame, label: str, group: str, seed: int = 42, flag: str = "train2") -> DataFrame:
    """Every class has the same number of train groups: four fifths of the smallest class."""
    ranked = ranked_groups(df, label, group, seed)
    smallest = ranked.agg(F.min("class_groups")).scalar()
    chosen = ranked.where(F.col("g_rank") <= F.floor(smallest * 4 / 5))
    return flag_members(df, chosen, [label, group], flag)


def assign_folds(
    df: DataFrame, label: str, group: str, folds: int, seed: int = 42, keep: bool = False
) -> DataFrame:
    """Adds ``fold``: the groups of each class dealt to folds whose sizes differ by at most one."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    ranked = _ranked(df, label, group, seed, keep).select(
        label,
        group,
        (F.col("g_rank") - 1).alias("position"),
        F.expr(f"class_groups div {folds}").alias("base"),
        (F.col("class_groups") % folds).alias("larger"),
    )
    wide = F.col("larger") * (F.col("base") + 1)
    fold = F.when(
        F.col("position") < wide, F.expr("position div (base + 1)")
    ).otherwise(F.col("larger") + F.expr("(position - larger * (base + 1)) div greatest(base, 1)"))
    return null_safe_join(df, ranked.select(label, group, fold.cast("int").alias("fold")), [label, group])


def kfold_flags(df: DataFrame, label: str, group: str, folds: int, seed: int = 42) -> DataFrame:
    """One 0/1 column per fold, ``train0`` ...: 0 marks the fold's held-out rows."""
    dealt = assign_folds(df, label, group, folds, seed)
    flags = [(F.col("fold") != f).cast("int").alias(f"train{f}") for f in range(folds)]
    return dealt.select("*", *flags)


def minimum_class_groups(df: DataFrame, label: str, group: str) -> DataFrame:
    """Number of distinct groups of the class that has fewest."""
    per_class = df.groupBy(label).agg(F.count_distinct(group).alias("groups"))
    return per_class.agg(F.min("groups").alias("min_groups"))
