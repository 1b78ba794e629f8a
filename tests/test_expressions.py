"""Hand-worked cases of vector functions, reductions, scalers, windows and texts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecflow.functions import vectors as V
from vecflow.operators import prep, reduction, reports, scaling, signals
from vecflow.plans import grids


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(values):
    return F.array(*[F.lit(float(v)) for v in values])


def nested(rows):
    return F.array(*[lit(r) for r in rows])


def test_distances(spark):
    a, b = lit([1, 2, 3]), lit([2, 0, 4])
    assert one(spark, V.distance(a, b, "l2")) == 6
    assert one(spark, V.distance(a, b, "L2")) == 6
    assert one(spark, V.distance(a, b, "euclidean")) == pytest.approx(math.sqrt(6))
    assert one(spark, V.distance(a, b, "manhattan")) == 4
    assert one(spark, V.distance(a, b, "inner_product")) == -14
    assert one(spark, V.distance(a, b, "cosine")) == pytest.approx(1 - 14 / math.sqrt(14 * 20))
    assert one(spark, V.distance(a, b, "correlation")) == pytest.approx(1 - np.corrcoef([1, 2, 3], [2, 0, 4])[0, 1])


def test_zero_vector_has_distance_one(spark):
    assert one(spark, V.distance(lit([0, 0]), lit([1, 2]), "cosine")) == 1
    assert one(spark, V.unit(lit([0, 0]))) == [0, 0]
    assert one(spark, V.distance(lit([5, 5]), lit([1, 2]), "correlation")) == 1


def test_bad_input_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        V.metric_name("hamming")
    with pytest.raises(PySparkException, match="different size"):
        one(spark, V.distance(lit([1]), lit([1, 2]), "l2"))


@pytest.mark.parametrize("percent,expected", [(25, 3.5), (15, 3.5), (10, 8.875)])
def test_iqr_mean(spark, percent, expected):
    assert one(spark, reduction.iqr_mean(lit([1, 2, 3, 4, 100, 5, 6, -50]), percent)) == expected


def test_split_means(spark):
    m = nested([[1, 2, 3, 4, 5, 6, 7]])
    assert one(spark, reduction.split_means(m, 3)) == [1.5, 3.5, 6]
    with pytest.raises(PySparkException, match="fewer frames"):
        one(spark, reduction.split_means(nested([[1, 2]]), 3))


def test_reductions_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3, 13)) ** 3

    def numpy_reduce(part, percent):
        if percent is None:
            return part.mean(axis=1)
        low, high = np.percentile(part, [percent, 100 - percent], axis=1, keepdims=True)
        spread = high - low
        kept = np.where((part >= low - 1.5 * spread) & (part <= high + 1.5 * spread), part, np.nan)
        return np.nanmean(kept, axis=1)

    for name, (percent, splits) in reduction.REDUCTIONS.items():
        size = 13 // splits
        parts = [m[:, i * size : (i + 1) * size if i < splits - 1 else 13] for i in range(splits)]
        expected = np.concatenate([numpy_reduce(p, percent) for p in parts])
        assert one(spark, reduction.reduce_matrix(nested(m), name)) == pytest.approx(list(expected)), name
    with pytest.raises(ValueError, match="unknown vector operation"):
        reduction.reduce_matrix(nested(m), "median")


def test_frame_scaling(spark):
    m = [[1, 5, 2], [3, 5, 4]]
    assert one(spark, reduction.minmax_frames(nested(m))) == [[0, 0, 0], [1, 0, 1]]
    assert one(spark, reduction.standardise_frames(nested(m))) == [[-1, 0, -1], [1, 0, 1]]


def test_minmax_scaler(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "vector array<double>")
    test = spark.createDataFrame([([4.0, 5.0],), ([1.0, 6.0],)], "vector array<double>")
    scaled = scaling.apply_minmax(test, scaling.fit_minmax(train, "vector"))
    assert sorted(r[0] for r in scaled.collect()) == [[0, 1], [1.5, 0]]


def test_joint_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 9.0)], "a double, b double")
    rows = scaling.scale_jointly(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["a_scaled"], r["b_scaled"]) for r in rows] == [(0, 0.5), (0.25, 1)]


def test_scalar_quantisation(spark):
    low, high = lit([0, 2]), lit([1, 2])
    assert one(spark, V.sq8_encode(lit([0.5, 2]), low, high)) == [127, 0]
    assert one(spark, V.sq8_decode(F.array(F.lit(127), F.lit(0)), low, high)) == [0.5, 2]


@pytest.mark.parametrize(
    "length,overlap,count", [(10, 5, 11), (10, 0, 6), (7, 5, 27), (5, 2, 19), (5, 0, 12), (2, 1, 59), (2, 0, 30), (61, 0, 0)]
)
def test_windows(spark, length, overlap, count):
    rows = prep.windows(spark.range(1), length, overlap).collect()
    assert len(rows) == count
    assert one(spark, prep.window_count(F.lit(length), F.lit(overlap))) == count
    if (length, overlap) == (10, 5):
        assert [(rows[0]["start_time"], rows[0]["end_time"]), (rows[-1]["start_time"], rows[-1]["end_time"])] == [(0, 10), (50, 60)]


@pytest.mark.parametrize("overlap", [10, 12, -1])
def test_bad_windows(spark, overlap):
    with pytest.raises(ValueError):
        prep.windows(spark.range(1), 10, overlap)


def test_segment_filters(spark):
    df = spark.range(8).withColumnRenamed("id", "segment")
    numbers = lambda **parts: sorted(r[0] for r in prep.keep_segments(df, "segment", **parts).collect())
    assert numbers() == [1, 2, 3, 4]
    assert numbers(first=True, last=True) == [0, 1, 2, 3, 4, 5]
    assert numbers(regular=False) == list(range(8))
    kept = prep.training_extract(df.withColumn("train1", F.lit(1)), "train1", "segment")
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_fixed_text_rounds_the_stored_value(spark):
    values = [0.125, 0.375, 2.5, 40.595, 57.99495, 0.0, 0.005, 1.005, 99.995, 0.99999, 12345678.905, -3.14159, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4):
        rows = df.select("v", reports.fixed_text(F.col("v"), digits).alias("t")).collect()
        assert [r["t"] for r in rows] == [f"{r['v']:.{digits}f}" for r in rows]


def test_parameter_literals(spark):
    texts = [
        "{'params':'IVF1000,Flat', 'nprobe': 20}",
        "{'params':'HNSW50,Flat', 'efConstruction': 300,'efSearch': 50}",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [tuple(r["p"]) for r in df.select(grids.literal_fields(F.col("t")).alias("p")).collect()]
    assert rows == [("IVF1000,Flat", "20", "None", "None"), ("HNSW50,Flat", "None", "300", "50")]
    labels = df.select(grids.factory_labels(F.col("t"))["full_search"].alias("x")).collect()
    assert labels[1]["x"] == "HNSW50,Flat-300-50"
    stored = "{'index_type': 'IVF_PQ', 'params': {'m': 10, 'nlist': 1000}, 'nprobe': 20}"
    found = one(spark, grids.stored_labels(F.lit(stored))).asDict()
    assert found == {"index_factory": "IVF1000,PQ10", "index_full": "IVF_PQ-1000-20", "pq_m": "10"}


def test_grid_sizes(spark):
    assert grids.preparation_grid(spark).count() == 60
    assert grids.exact_grid(spark).count() == 216
    assert grids.exact_grid_v3(spark).count() == 16
    assert grids.stored_grid(spark).count() == 5472
    sizes = {"flat": 48, "ivf": 240, "hnsw_50": 96, "hnsw": 288, "stored_pq": 80, "stored_ivf": 240}
    for name, size in sizes.items():
        grid = grids.index_grid(spark, grids.INDEX_LISTS[name]())
        assert grid.count() == grid.distinct().count() == size, name


def test_vote_function(spark):
    from vecflow.operators.partitions import register_majority

    vote = register_majority(spark)
    assert spark.sql(f"SELECT {vote}(array(3, 0, 0, 3)) AS x").first()["x"] == 0


def test_delta_needs_full_windows(spark):
    with pytest.raises(PySparkException, match="at least 9"):
        one(spark, signals.delta(nested([[1], [2], [3]])))
