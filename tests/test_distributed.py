"""Ranks, percentiles and splits: the wide path must equal the small one, also with hot values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.operators import evaluation, ranking, reduction, reports, signals, splits
from vecflow.sources import stores


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, a third share one value."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{int(rng.integers(40))}"
        value = 5.0 if rng.random() < 0.33 else float(np.round(rng.normal(5, 3), 2))
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, key string, value double").repartition(8).cache()


def test_quantiles_by_ranges(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    pdf = skewed.toPandas()
    for keys in ([], ["key"]):
        found = ranking.exact_quantiles(skewed, keys, "value", probs, "q", rows_per_range=200).collect()
        for row in found:
            values = pdf["value"] if not keys else pdf[pdf["key"] == row["key"]]["value"]
            assert row["q"] == pytest.approx(list(np.quantile(values, probs)))
        assert len(found) == (1 if not keys else pdf["key"].nunique())


def test_iqr_mean_paths_agree(skewed):
    small = reduction.grouped_iqr_mean(skewed, ["key"], "value", 25).orderBy("key").collect()
    wide = reduction.grouped_iqr_mean(skewed, ["key"], "value", 25, rows_per_range=100).orderBy("key").collect()
    assert [r["key"] for r in small] == [r["key"] for r in wide]
    assert [r["kept"] for r in small] == [r["kept"] for r in wide]
    assert [r["iqr_mean"] for r in small] == pytest.approx([r["iqr_mean"] for r in wide])


@pytest.mark.parametrize("descending", [False, True])
def test_ordinals_by_ranges(skewed, descending):
    found = ranking.with_ordinal(skewed, "value", "id", descending, rows_per_range=150)
    rows = found.orderBy("ordinal").collect()
    expected = sorted(skewed.collect(), key=lambda r: ((-1 if descending else 1) * r["value"], r["id"]))
    assert [r["id"] for r in rows] == [r["id"] for r in expected]
    assert [r["ordinal"] for r in rows] == list(range(6000))


def test_changed_scores(spark, skewed):
    df = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.8), (4, 0.8), (5, 0.0)], "id long, score double")
    assert [r["id"] for r in ranking.drop_unchanged(df, "score", "id").orderBy("id").collect()] == [1, 3, 5]
    zero_first = spark.createDataFrame([(1, 0.0), (2, 0.5)], "id long, score double")
    assert [r["id"] for r in ranking.drop_unchanged(zero_first, "score", "id", descending=False).collect()] == [2]
    wide = ranking.drop_unchanged(skewed, "value", "id", rows_per_range=100).select("id").orderBy("id").collect()
    assert wide == ranking.drop_unchanged(skewed, "value", "id").select("id").orderBy("id").collect()


def test_every_nth(skewed):
    wide = ranking.every_nth(skewed, "value", "id", 7, rows_per_range=150)
    assert wide.count() == -(-6000 // 7)


def test_latest_by_key(skewed):
    kept = ranking.latest_by_key(skewed, "key", F.col("id")).collect()
    assert {r["key"]: r["id"] for r in kept} == {
        r["key"]: r["m"] for r in skewed.groupBy("key").agg(F.max("id").alias("m")).collect()
    }


@pytest.fixture(scope="module")
def grouped(spark):
    """Classes with 7, 10, 11 and 1 groups; groups of very different size."""
    rows = []
    for label, groups in enumerate([7, 10, 11, 1]):
        for g in range(groups):
            rows += [(label, f"g{g}", r) for r in range(1 + 40 * (g == 0))]
    return spark.createDataFrame(rows, "label int, grp string, row int").cache()


def groups_by_flag(df, flag):
    rows = df.groupBy("label", "grp").agg(F.min(flag).alias("a"), F.max(flag).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)  # no group on both sides
    found = {}
    for r in rows:
        found.setdefault(r["label"], []).append(r["a"])
    return found


def test_holdout(grouped):
    found = groups_by_flag(splits.holdout(grouped, "label", "grp"), "train1")
    assert {k: (v.count(0), v.count(1)) for k, v in found.items()} == {0: (2, 5), 1: (2, 8), 2: (3, 8), 3: (1, 0)}


def test_balanced_holdout(grouped):
    found = groups_by_flag(splits.balanced_holdout(grouped.where("label < 3"), "label", "grp"), "train2")
    assert {k: v.count(1) for k, v in found.items()} == {0: 5, 1: 5, 2: 5}


def test_folds(grouped):
    dealt = splits.kfold_flags(grouped, "label", "grp", 4)
    sizes = dealt.select("label", "grp", "fold").distinct().groupBy("label", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["label"], []).append(r["count"])
    assert sorted(by_label[2], reverse=True) == [3, 3, 3, 2]
    assert all(max(v) - min(v) <= 1 for k, v in by_label.items() if k < 3)
    assert dealt.where("train0 + train1 + train2 + train3 <> 3").isEmpty()
    with pytest.raises(ValueError):
        splits.assign_folds(grouped, "label", "grp", 1)


def test_split_does_not_depend_on_partitions(spark, grouped):
    chosen = lambda df: sorted((r["label"], r["grp"]) for r in df.where("train1 = 0").collect())
    before = chosen(splits.holdout(grouped, "label", "grp"))
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert chosen(splits.holdout(grouped.repartition(3), "label", "grp")) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    assert chosen(splits.holdout(grouped, "label", "grp", seed=43)) != before


def gappy_rows(spark):
    rows = [(i, None if i % 5 == 0 else (2**60 + i % 7), None if i % 11 == 0 else f"t{i % 3}", f"k{i:03d}") for i in range(60)]
    return spark.createDataFrame(rows, "id long, score long, text string, name string").repartition(5)


@pytest.mark.parametrize("value, descending", [("score", False), ("score", True), ("text", False), ("text", True)])
@pytest.mark.parametrize("tie", ["id", "name"])
def test_order_is_the_same_in_ranges(spark, value, descending, tie):
    """Nulls, texts as values and ties, and numbers that a double can't tell apart."""
    df = gappy_rows(spark)
    for add in (ranking.with_ordinal, ranking.with_previous):
        small = sorted(map(tuple, add(df, value, tie, descending, out="o").collect()), key=repr)
        large = sorted(map(tuple, add(df, value, tie, descending, out="o", rows_per_range=10).collect()), key=repr)
        assert small == large and len(small) == 60
    order = sorted(df.collect(), key=lambda r: r[tie])
    order = sorted([r for r in order if r[value] is not None], key=lambda r: r[value], reverse=descending)
    places = {r["id"]: r["o"] for r in ranking.with_ordinal(df, value, tie, descending, "o", 10).collect()}
    nulls = 60 - len(order)
    assert [places[r["id"]] for r in order] == list(range(nulls, 60))


def test_reports_keep_rows_without_score(spark):
    df = gappy_rows(spark)
    assert ranking.drop_unchanged(df, "score", "id", rows_per_range=10).where("score IS NULL").count() == ranking.drop_unchanged(df, "score", "id").where("score IS NULL").count() == 12
    assert sorted(map(tuple, ranking.every_nth(df, "score", "id", 20, 10).collect())) == sorted(map(tuple, ranking.every_nth(df, "score", "id", 20).collect()))


def test_null_labels_and_groups_are_dealt(spark):
    rows = [(i, None if i % 6 == 0 else i % 2, None if i % 7 == 0 else f"g{i % 10}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, grp string")
    dealt = splits.assign_folds(df, "label", "grp", 3).collect()
    assert len(dealt) == 120 and all(r["fold"] in (0, 1, 2) for r in dealt)
    groups = {}
    for r in dealt:
        groups.setdefault((r["label"], r["grp"]), set()).add(r["fold"])
    assert all(len(f) == 1 for f in groups.values())
    flagged = splits.holdout(df, "label", "grp").collect()
    assert len(flagged) == 120 and {r["train1"] for r in flagged if r["label"] is None} == {0, 1}


def test_grouped_mean_of_a_null_key(spark):
    df = spark.createDataFrame([(None, float(x)) for x in (1, 2, 3, 4, 100, 5, 6, -50)] + [("a", 1.0)], "k string, x double")
    for rows in (3, 100):
        found = {r["k"]: r["iqr_mean"] for r in reduction.grouped_iqr_mean(df, ["k"], "x", 25, rows).collect()}
        assert found == {None: 3.5, "a": 1.0}


def test_short_signals_are_framed(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 16), (3, [1.0] * 17), (4, None)], "id int, s array<double>")
    frames = signals.framed(df, "s", 16, 8).collect()
    count = {i: [r["x"] for r in frames if r["id"] == i] for i in (1, 2, 3, 4)}
    assert [len(count[i]) for i in (1, 2, 3, 4)] == [1, 3, 3, 1] and all(len(x) == 16 for f in count.values() for x in f)
    assert count[1][0][7:11] == [0.0, 1.0, 2.0, 0.0] and [sum(x) for x in count[3]] == [8.0, 16.0, 9.0]


def test_missing_predictions_are_misses(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 2)], "y int, p int")
    assert tuple(evaluation.accuracy(df, "y", "p").first()) == (0.5, 4)


def test_top_report_takes_the_best_first(spark):
    df = spark.createDataFrame([(1, 0.9, "b"), (2, 0.9, "a"), (3, 0.8, "a"), (4, 0.8, "b"), (5, 0.7, "a"), (6, None, "a")], "id int, score double, f string")
    assert [r["id"] for r in reports.distinct_scores_report(df, 4, "score", ["f", "id"]).orderBy(F.col("score").desc()).collect()] == [2, 3]


def test_inserts_and_recreation(spark, tmp_path):
    place, columns = str(tmp_path / "t"), "id bigint, vector_data array<double>, label int"
    rows = spark.createDataFrame([([1.0], 1), ([2.0], 2), ([3.0], 3)], "vector_data array<double>, label int")
    stores.create_collection(spark, "vt", "L2", "Flat", recreate=True, columns=columns, location=place)
    stores.insert_records(rows, "vt")
    stores.insert_records(rows, "vt")
    assert spark.table("vt").select("id").distinct().count() == 6
    stores.create_collection(spark, "vt", "L2", "Flat", recreate=True, columns=columns, location=place)
    assert spark.table("vt").count() == 0
    stores.drop_collection(spark, "vt")


def test_versions_are_compared_as_numbers():
    assert max(["version=999999-b", "version=1000000-a"], key=stores._version_number) == "version=1000000-a"
