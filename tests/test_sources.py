"""Files and stores, also when a write is repeated or breaks off."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecflow.operators import partitions, prep
from vecflow.sources import files, stores


def test_csv_declares_its_schema(spark, tmp_path):
    path = str(tmp_path / "a")
    files.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    assert files.read_csv(spark, path, "a tinyint, b string").collect() == [(1, "x")]
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        files.read_csv(spark, path, "a int, b int").collect()


def test_snake_case(spark):
    assert files.snake_case(spark.createDataFrame([(1, 2)], "`queen status` int, `Hive temp` int")).columns == ["queen_status", "hive_temp"]


def test_listing(spark, tmp_path):
    for name in ("a_1.wav", "a_2.wav", "b_1.wav", "note.txt"):
        (tmp_path / name).write_bytes(b"xy")
    names = lambda **o: sorted(r["name"] for r in files.list_files(spark, str(tmp_path), **o).collect())
    assert names(prefix="a_") == ["a_1.wav", "a_2.wav"]
    assert names(pattern="*.wav") == ["a_1.wav", "a_2.wav", "b_1.wav"]


def test_overlaps(spark, tmp_path):
    rows = [(10, "0", 1), (10, "5", 2), (10, "extra", 3), (7, "5", 4)]
    files.write_segments(spark.createDataFrame(rows, "seg_len int, overlap string, x int"), str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r[0] for r in files.available_overlaps(stored, 10).collect()) == [0, 5]
    assert files.all_overlaps(stored, 10, "5").count() == 1 and files.all_overlaps(stored, 10, "all").count() == 3


def test_concat_skips_what_cannot_be_read(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "a"))
    files.write_csv(spark.createDataFrame([(2, 3)], "a int, b int"), str(tmp_path / "b"))
    rows, messages = files.concat_csvs(spark, [str(tmp_path / n) for n in ("a", "none", "b")])
    assert sorted((r["a"], r["b"]) for r in rows.collect() if r["b"]) == [("2", "3")] and rows.count() == 2
    assert len(messages) == 1 and "none" in messages[0]
    with pytest.raises(ValueError, match="empty"):
        files.concat_csvs(spark, [])
    with pytest.raises(ValueError, match="no file"):
        files.concat_csvs(spark, [str(tmp_path / "none")])


def test_materialise_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    for _ in range(3):
        assert stores.materialised(spark, path, build).count() == 3
    assert len(calls) == 1
    os.remove(f"{path}/_SUCCESS")  # a write that broke off counts as absent
    stores.materialised(spark, path, build)
    assert len(calls) == 2


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    assert stores.read_newest(spark, root) is None
    stores.write_version(spark.range(1), root)
    newest = stores.write_version(spark.range(2), root)
    assert stores.read_newest(spark, root).count() == 2
    os.remove(f"{newest}/_SUCCESS")
    assert stores.read_newest(spark, root).count() == 1


def test_merge_takes_the_last_part(spark):
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert sorted(tuple(r) for r in stores.merge_parts([a, b], "k").collect()) == [(1, "old"), (2, "new"), (3, "new")]


def test_collection(spark, tmp_path):
    name = stores.collection_name(["pe-mfcc_40"], "mean", 10, 5)
    assert name == "pe_mfcc_40_vectors_mean_len10_overlap5"
    make = lambda **o: stores.create_collection(
        spark, name, "COSINE", "IVF8,Flat", extra="station string", location=str(tmp_path / "c"), **o
    )
    make(recreate=True)
    records = spark.createDataFrame([([1.0, 2.0], 1, "north")], "vector_data array<double>, queen_status int, station string")
    stores.insert_records(records, name)
    stores.insert_records(records.drop("station"), name)
    assert stores.count_rows(spark, make()) == 2
    assert stores.describe_collection(spark, name) == {"metric": "cosine", "index": "IVF8,Flat", "built": "false", "dim": "2"}
    assert spark.table(name).where("station IS NULL").count() == 1
    with pytest.raises(ValueError, match="not in"):
        stores.insert_records(records.withColumn("other", F.lit(1)), name)
    assert stores.count_rows(spark, make(reset=True)) == 0
    stores.drop_collection(spark, name)
    assert not spark.catalog.tableExists(name)


def test_prefix_join_needs_no_pairs(spark):
    metadata = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "prefix string")
    listing = spark.createDataFrame([("abcd",), ("abx",), ("q",)], "name string")
    joined = prep.files_by_prefix(metadata, listing, "prefix", "name")
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.select("prefix", "name").collect()) == [("ab", "abcd"), ("ab", "abx"), ("abc", "abcd")]


def test_partition_functions(spark):
    def doubled(batches, number):
        for batch in batches:
            yield batch.assign(x=batch["x"] * 2, part=number)

    lines = spark.range(100).select(F.to_json(F.struct(F.col("id").alias("x"))).alias("value"))
    found = partitions.map_records(lines, "x long", doubled, "x long, part int", partitions=4).collect()
    assert sorted(r["x"] for r in found) == [2 * i for i in range(100)] and len({r["part"] for r in found}) == 4
    odd = spark.createDataFrame([("{}",), (None,), ("no json",), ('{"x": 3}',)], "value string")
    kept = partitions.map_records(odd, "x long", lambda batches, number: batches, "x long", partitions=1).collect()
    assert sorted((r["x"] is not None, r["x"] or 0) for r in kept) == [(False, 0)] * 3 + [(True, 3)]


def test_a_partition_is_one_call_whatever_its_batches(spark):
    def sizes(batches, number):
        found = [len(batch) for batch in batches]
        yield pd.DataFrame({"batches": [len(found)], "n": [sum(found)], "part": [number]})

    found = partitions.map_partitions(spark.range(25_000).coalesce(1), sizes, "batches long, n long, part int").collect()
    assert [(r["n"], r["part"]) for r in found] == [(25_000, 0)] and found[0]["batches"] > 1
    empty = partitions.map_partitions(spark.range(0).repartition(1), sizes, "batches long, n long, part int").collect()
    assert all(r["n"] == 0 for r in empty)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 1.0)], "a double, b double, c double")
    found = {(r["a"], r["b"]): r["corr"] for r in prep.correlations(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == pytest.approx(1) and found[("a", "c")] is None and found[("c", "c")] is None


def test_collection_is_searched_by_its_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i)], i % 3) for i in range(40)], "id long, vector_data array<double>, label int")
    asked = rows.select("id", F.col("vector_data").alias("vector")).where("id < 5")
    columns = "id bigint, vector_data array<double>, label int"
    hits = {}
    for text in ("Flat", stores.index_text("IVF_FLAT", {"nlist": 4})):
        stores.create_collection(spark, "searched", "L2", text, recreate=True, columns=columns, location=str(tmp_path / text))
        stores.insert_records(rows, "searched")
        if text != "Flat":
            with pytest.raises(ValueError, match="not built"):
                stores.search_collection(asked, "searched", 3)
        stores.build_collection_index(spark, "searched")
        assert stores.describe_collection(spark, "searched")["built"] == "true"
        hits[text] = sorted(map(tuple, stores.search_collection(asked, "searched", 3, nprobe=4, fields=["label"]).select("query_id", "rank", "neighbor_id").collect()))
    assert len(set(map(tuple, hits.values()))) == 1 and len(hits["Flat"]) == 15
    stores.insert_records(rows, "searched")
    assert stores.describe_collection(spark, "searched")["built"] == "false"
    stores.drop_collection(spark, "searched")


def test_index_texts():
    assert stores.index_text("IVF_PQ", {"m": 10, "nlist": 1000}) == "IVF1000,PQ10" and stores.index_text("FLAT") == "Flat"
    assert stores.index_text("IVF_PQ", {"nlist": 64, "m": 1, "nbits": 16}) == "IVF64,PQ1x16" and stores.index_text("IVF_PQ", {"nlist": 64, "m": 1, "nbits": 8}) == "IVF64,PQ1"
    for kind, params in (("IVF_FLAT", {"nlist": 8, "radius": 1}), ("FLAT", {"nlist": 8}), ("IVF_PQ", {"nlist": 64, "m": 1, "nbits": 32}), ("HNSW", {"M": 16}), ("IVF_PQ", {"nlist": 5}), ("IVF_FLAT", {})):
        with pytest.raises(ValueError):
            stores.index_text(kind, params)
