"""Queries on sources, projections, joins, aggregates, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecflow.catalog.registry import Tables, query, r6
from vecflow.functions.vectors import array_sum, doubles
from vecflow.operators import prep, ranking, reports, splits
from vecflow.operators.evaluation import describe_classes, report_with_averages
from vecflow.plans import grids
from vecflow.session import scratch_path
from vecflow.sources import files, stores

# ---------------------------------------------------------------- sources and sinks


@query("s01_csv_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders""")
def csv_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    files.write_csv(t.orders.select(*columns).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    back = files.read_csv(t.spark, path, schema, "yyyy-MM-dd HH:mm:ss")
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("s02_narrow_csv", """
SELECT l_linenumber, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ALL""")
def narrow_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "narrow")
    files.write_csv(t.lineitem.select("l_linenumber", "l_quantity", "l_returnflag"), path)
    back = files.read_csv(t.spark, path, "l_linenumber tinyint, l_quantity double, l_returnflag string")
    return back.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def _segment_table(t: Tables) -> DataFrame:
    base = t.supplier.select("s_suppkey", "s_name")
    parts = [
        prep.windows(base, length, overlap, base="s_name").withColumns({"seg_len": F.lit(length), "overlap": F.lit(overlap)})
        for length, overlap in grids.PREPARATION["segment"]
    ]
    return files.union_all(parts)


@query("s05_available_overlaps", """
SELECT o AS overlap, count(*) * max(n) AS sub_segments FROM supplier, (VALUES (0, 6), (5, 11)) AS w(o, n) GROUP BY o""")
def available_overlaps(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "segments")
    files.write_segments(_segment_table(t), path)
    stored = t.spark.read.parquet(path)
    found = files.available_overlaps(stored, 10)
    return files.all_overlaps(stored, 10, "all").join(found, "overlap").groupBy("overlap").agg(
        F.count(F.lit(1)).alias("sub_segments")
    )


@query("s06_array_scan", """
SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]) + 1e-9, 6) AS total FROM embeddings""")
def array_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "matrices")
    t.embeddings.select("vec_id", "embedding").write.parquet(path)
    back = t.spark.read.schema("vec_id bigint, embedding array<float>").parquet(path)
    return back.select("vec_id", F.size("embedding").alias("n"), r6(array_sum(doubles(F.col("embedding")))).alias("total"))


@query("s07_keyed_lookup", """
SELECT doc_id, CASE WHEN vec_id IS NULL THEN 0 ELSE 1 END AS found, round(embedding[1]::DOUBLE + 1e-9, 6) AS first_value
FROM labels LEFT JOIN embeddings ON doc_id = vec_id""")
def keyed_lookup(t: Tables) -> DataFrame:
    stored = t.embeddings.select(F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("vector"))
    joined = prep.attach_vectors(t.labels.select("doc_id"), stored, "doc_id")
    return joined.select(
        "doc_id", F.col("vector").isNotNull().cast("int").alias("found"), r6(F.get("vector", F.lit(0))).alias("first_value")
    )


@query("s07_missing_keys", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_keys(t: Tables) -> DataFrame:
    stored = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return prep.missing_vectors(t.labels.select("doc_id"), stored, "doc_id")


@query("s08_feature_write", """
SELECT 'mean' AS feature, count(*) AS n, round(sum(list_avg(embedding::DOUBLE[])) + 1e-9, 6) AS total FROM embeddings
UNION ALL
SELECT 'peak', count(*), round(sum(list_max(embedding::DOUBLE[])) + 1e-9, 6) FROM embeddings""")
def feature_write(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "features")
    v = doubles(F.col("embedding"))
    pairs = F.array(
        F.struct(F.lit("mean").alias("feature"), (array_sum(v) / F.size(v)).alias("value")),
        F.struct(F.lit("peak").alias("feature"), F.array_max(v).alias("value")),
    )
    stores.write_features(t.embeddings.select("vec_id", F.inline(pairs)), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("s09_merge_parts", """
SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price FROM orders""")
def merge_parts(t: Tables) -> DataFrame:
    first = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    second = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    merged = stores.merge_parts([first, second], "o_orderkey")
    root = scratch_path(t.spark, "merged")
    stores.write_version(first, root)
    stores.write_version(merged, root)
    return stores.read_newest(t.spark, root).select("o_orderkey", F.round("price", 2).alias("price"))


@query("s10_cached_table", """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey""")
def cached_table(t: Tables) -> DataFrame:
    path = stores.parameter_path(scratch_path(t.spark, "cache"), feature="spent", seg_len=10, overlap="all")
    build = lambda: t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    stores.materialised(t.spark, path, build)
    return stores.materialised(t.spark, path, build)


FLAGGED_LINES_SQL = """
WITH g AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42_', o_custkey)), o_custkey) AS rn,
              count(*) OVER (PARTITION BY o_orderstatus) AS n FROM g),
f AS (SELECT o_orderkey, o_orderstatus, CASE WHEN rn > (n + 4) // 5 THEN 1 ELSE 0 END AS train1
      FROM orders JOIN rk USING (o_orderstatus, o_custkey)),
l AS (SELECT l_orderkey, l_linenumber, train1 FROM lineitem JOIN f ON l_orderkey = o_orderkey)"""


def _flagged_lines(t: Tables) -> DataFrame:
    flagged = splits.holdout(t.orders, "o_orderstatus", "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "train1")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(flagged, "l_orderkey")


@query("s11_extracts", FLAGGED_LINES_SQL + """
SELECT 'train' AS side, l_linenumber, count(*) AS n FROM l WHERE train1 = 1 AND l_linenumber NOT IN (0, 5) GROUP BY ALL
UNION ALL
SELECT 'test', l_linenumber, count(*) FROM l WHERE train1 = 0 AND l_linenumber IN (5, 1, 2, 3, 4) GROUP BY ALL""")
def extracts(t: Tables) -> DataFrame:
    lines = _flagged_lines(t)
    root = scratch_path(t.spark, "extracts")
    train = stores.materialised(
        t.spark, f"{root}/training_1", lambda: prep.training_extract(lines, "train1", "l_linenumber")
    )
    test = stores.materialised(
        t.spark, f"{root}/testing_1_0_1_1",
        lambda: prep.keep_segments(prep.select_side(lines, "test", "train1"), "l_linenumber", last=True),
    )
    count = lambda df, side: df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(train, "train").unionByName(count(test, "test"))


@query("s12_csv_sink", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sink")
    for _ in range(2):  # the second write replaces the first
        files.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return files.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


def _result_rows(t: Tables) -> DataFrame:
    """Orders read as result rows: price as accuracy, pending orders as skipped runs."""
    given = {
        "skipped": F.col("o_orderstatus") == "P",
        "accuracy": F.col("o_totalprice") / 1_000_000,
        "feature": F.col("o_orderpriority"),
        "vote_type": F.lit("uniform"),
        "neighbors": F.lit(15),
        "row_key": F.md5(F.col("o_orderkey").cast("string").cast("binary")),
    }
    return t.orders.select(*[
        (given[c] if c in given else F.lit(None).cast("string")).alias(c) for c in files.RESULT_FIELDS
    ])


@query("s14_append_results", """
SELECT feature, 2 * count(*) AS n, count(DISTINCT row_key) AS runs, round(max(accuracy) + 1e-9, 6) AS best
FROM (SELECT o_orderpriority AS feature, md5(o_orderkey::VARCHAR) AS row_key, o_totalprice / 1000000 AS accuracy
      FROM orders WHERE o_orderstatus <> 'P') GROUP BY feature""")
def append_results(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "results")
    for _ in range(2):
        files.append_results(_result_rows(t), path)
    return t.spark.read.parquet(path).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("runs"), r6(F.max("accuracy")).alias("best")
    )


@query("s15_json_documents", """
SELECT 'F' AS row_key, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""")
def json_documents(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "documents")
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("row_key"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    files.write_documents(counts, path)
    files.write_documents(counts.where("row_key = 'F'"), path)  # a run replaces only its own document
    return files.read_document(t.spark, path, "F", "o_orderpriority string, n bigint")


VECTOR_SCHEMA = "id bigint, vector_data array<double>, label int"


@query("s16_vector_table", """
SELECT 'cosine' AS metric, 'IVF64,Flat' AS index, 'false' AS built, max(len(embedding))::VARCHAR AS dim, count(*) AS n FROM embeddings""")
def vector_table(t: Tables) -> DataFrame:
    name, place = "vecflow_s16", scratch_path(t.spark, "vecflow_s16")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vector_data"), "label")
    for _ in range(2):  # the second time over the files of the first
        stores.create_collection(t.spark, name, "COSINE", "IVF64,Flat", recreate=True, columns=VECTOR_SCHEMA, location=place)
        stores.insert_records(rows, name)
    stores.create_collection(t.spark, name, "COSINE", "IVF64,Flat", reset=True)  # found, emptied
    stores.insert_records(rows, name)
    found = stores.describe_collection(t.spark, name)
    return t.spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(*[F.lit(found[c]).alias(c) for c in ("metric", "index", "built", "dim")], "n")


@query("s17_insert_records", "SELECT label, 2 * count(*) AS n, 2 * count(*) AS ids FROM embeddings GROUP BY label")
def insert_records(t: Tables) -> DataFrame:
    name = "vecflow_s17"
    stores.create_collection(
        t.spark, name, "L2", "Flat", recreate=True, extra="note string", columns=VECTOR_SCHEMA, location=scratch_path(t.spark, name)
    )
    for _ in range(2):  # ids are given by the table
        stores.insert_records(t.embeddings.select(F.col("embedding").alias("vector_data"), "label"), name)
    return t.spark.table(name).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("s20_concat_csvs", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total,
       count(CASE WHEN event_type <> 'error' THEN props END) AS with_props FROM events GROUP BY event_type""")
def concat_csvs(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "slices")
    errors = F.col("event_type") == "error"
    files.write_csv(t.events.where(errors).select("event_id", "event_type", "value"), f"{root}/a")
    files.write_csv(t.events.where(~errors).select("event_id", "event_type", "value", "props"), f"{root}/b")
    rows, _ = files.concat_csvs(t.spark, [f"{root}/a", f"{root}/absent", f"{root}/b"])
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"),
        F.count("props").alias("with_props"),
    )


@query("s22_cache_all", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT 'mean' AS operation, count(*) AS n, round(sum(list_avg(v)) + 1e-9, 6) AS total FROM v
UNION ALL
SELECT 'mean_split_2', count(*), round(sum(list_avg(v)) + 1e-9, 6) FROM v""")
def cache_all(t: Tables) -> DataFrame:
    from vecflow.functions.vectors import frames_of, mean
    from vecflow.operators.reduction import reduce_matrix

    def build(configuration: dict) -> DataFrame:
        matrix = frames_of(doubles(F.col("embedding")), 8)
        return t.embeddings.select("vec_id", mean(reduce_matrix(matrix, configuration["operation"])).alias("value"))

    root = scratch_path(t.spark, "collections")
    wanted = [{"operation": "mean"}, {"operation": "mean_split_2"}]
    for path in stores.materialise_all(t.spark, root, wanted, build):
        t.spark.read.parquet(path)
    kept = t.spark.read.parquet(root)  # the parameter folders are partition columns
    return kept.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


# ---------------------------------------------------------------- projections and predicates


@query("p01_drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def drop_columns(t: Tables) -> DataFrame:
    return t.lineitem.drop(
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "not_there"
    )


@query("p02_key_prefix", "SELECT substr(c_name, 1, 16) AS prefix, count(*) AS n FROM customer GROUP BY prefix")
def key_prefix(t: Tables) -> DataFrame:
    return t.customer.groupBy(prep.prefix(F.col("c_name"), 16).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("p03_recode", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status
FROM orders""")
def recode(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", prep.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query("p04_time_parts", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS record_date, strftime(ts, '%H:%M:%S') AS record_time,
       isodow(ts) - 1 AS record_weekday, hour(ts) AS hour_of_day FROM events""")
def time_parts(t: Tables) -> DataFrame:
    parts = prep.time_parts(F.col("ts"))
    return t.events.select("event_id", *[c.alias(n) for n, c in parts.items()]).withColumn(
        "record_date", F.col("record_date").cast("string")
    )


@query("p05_tick_label", "SELECT event_id, strftime(ts, '%d %b %H:%M') AS tick FROM events")
def tick_label(t: Tables) -> DataFrame:
    return t.events.select("event_id", prep.tick_label(F.col("ts")).alias("tick"))


@query("p06_number_in_name", "SELECT c_custkey, replace(c_name, 'Customer#', '')::INT AS number FROM customer")
def number_in_name(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", prep.number_between(F.col("c_name"), "^Customer#", "\\.wav$").alias("number"))


@query("p07_segment_name", """
SELECT s_suppkey, concat_ws('_', s_name, (5 * i)::VARCHAR, (5 * i + 10)::VARCHAR) AS sub_segment_name
FROM supplier, range(11) AS r(i)""")
def segment_name(t: Tables) -> DataFrame:
    return prep.windows(t.supplier, 10, 5, base="s_name").select("s_suppkey", "sub_segment_name")


@query("p08_name_keys", """
SELECT o_orderkey, concat_ws('_', o_orderstatus, o_custkey, o_orderkey, o_orderpriority) AS file_key,
       concat_ws('_', o_orderstatus, o_custkey) AS group_key FROM orders""")
def name_keys(t: Tables) -> DataFrame:
    name = F.concat_ws("_", "o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority", F.lit("0"), F.lit("10"))
    keys = prep.name_keys(name)
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in keys.items()])


@query("p09_segment_parts", """
WITH c AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber)
SELECT 'regular' AS parts, * FROM c WHERE l_linenumber IN (1, 2, 3, 4)
UNION ALL SELECT 'ends', * FROM c WHERE l_linenumber IN (0, 5)
UNION ALL SELECT 'none', * FROM c""")
def segment_parts(t: Tables) -> DataFrame:
    choices = {
        "regular": {}, "ends": {"first": True, "last": True, "regular": False}, "none": {"regular": False},
    }
    counted = [
        prep.keep_segments(t.lineitem, "l_linenumber", **parts).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("parts", F.lit(name))
        for name, parts in choices.items()
    ]
    return files.union_all(counted)


@query("p10_training_extract", FLAGGED_LINES_SQL + """
SELECT l_linenumber, count(*) AS n FROM l WHERE train1 = 1 AND l_linenumber <> 0 AND l_linenumber <> 5 GROUP BY ALL""")
def training_extract(t: Tables) -> DataFrame:
    kept = prep.training_extract(_flagged_lines(t), "train1", "l_linenumber")
    return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("p11_split_side", FLAGGED_LINES_SQL + """
SELECT 'train' AS side, count(*) AS n FROM l WHERE train1 = 1
UNION ALL SELECT 'test', count(*) FROM l WHERE train1 = 0
UNION ALL SELECT 'all', count(*) FROM l""")
def split_side(t: Tables) -> DataFrame:
    lines = _flagged_lines(t)
    count = lambda side: prep.select_side(lines, side, "train1").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return files.union_all([count("train"), count("test"), count("all")])


def _gappy(t: Tables) -> DataFrame:
    """Events with nulls: no value for errors, no props for small values."""
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("value") >= 20, F.col("props")).alias("props"),
    )


GAPPY_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
                  CASE WHEN value >= 20 THEN props END AS props FROM events)"""


@query("p12_drop_any_null", GAPPY_SQL + " SELECT event_id, value FROM e WHERE value IS NOT NULL")
def drop_any_null(t: Tables) -> DataFrame:
    return prep.drop_empty(_gappy(t), ["value"]).select("event_id", "value")


@query("p13_drop_all_null", GAPPY_SQL + " SELECT event_id, value, props FROM e WHERE value IS NOT NULL OR props IS NOT NULL")
def drop_all_null(t: Tables) -> DataFrame:
    return prep.drop_empty(_gappy(t), ["value", "props"], how="all")


@query("p14_comparative", """
SELECT p_partkey, round(p_retailprice + 60 - 1000, 2) AS inside, round(p_size * 100.0::DOUBLE - 1000, 2) AS outside FROM part
WHERE p_retailprice + 60 >= 1000 AND p_size >= 10""")
def comparative(t: Tables) -> DataFrame:
    readings = t.part.select(
        "p_partkey", (F.col("p_retailprice") + 60).alias("hive_pressure"), (F.col("p_size") * 100.0).alias("weather_pressure")
    )
    series = prep.comparative_series(readings, "pressure", "p_partkey")
    return series.select("p_partkey", F.round("inside", 2).alias("inside"), F.round("outside", 2).alias("outside"))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _literals(t: Tables) -> DataFrame:
    """Parameter texts written from line items: cells by line number, storage by flag, probes by quantity."""
    storage = F.when(F.col("l_returnflag") == "A", "Flat").when(F.col("l_returnflag") == "N", "SQ8").otherwise("PQ10")
    probes = F.when(F.col("l_tax") > 0, F.format_string(", 'nprobe': %d", F.col("l_quantity").cast("int"))).otherwise("")
    text = F.concat(F.lit("{'params':'IVF"), F.col("l_linenumber") * 1000, F.lit(","), storage, F.lit("'"), probes, F.lit("}"))
    return t.lineitem.select(*LINE_KEY, text.alias("index_params"))


LITERAL_SQL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    concat('IVF', l_linenumber * 1000, ',', CASE l_returnflag WHEN 'A' THEN 'Flat' WHEN 'N' THEN 'SQ8' ELSE 'PQ10' END) AS f,
    CASE WHEN l_tax > 0 THEN l_quantity::INT::VARCHAR ELSE 'None' END AS p FROM lineitem)"""


@query("p15_parameter_literal", LITERAL_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, f AS index_factory, p AS nprobe, 'None' AS ef_construction, 'None' AS ef_search
FROM x""")
def parameter_literal(t: Tables) -> DataFrame:
    parsed = grids.with_literals(_literals(t), "index_params", "p")
    return parsed.select(*LINE_KEY, "p.*")


@query("p16_index_label", LITERAL_SQL + """
, y AS (SELECT *, l_linenumber * 1000 AS nlist, CASE l_returnflag WHEN 'A' THEN 'IVF_FLAT' WHEN 'N' THEN 'IVF_SQ8' ELSE 'IVF_PQ' END AS kind
        FROM lineitem)
SELECT 'factory' AS source, f || '-' || p AS label, count(*) AS n FROM x GROUP BY ALL
UNION ALL
SELECT 'stored', concat('IVF', nlist, CASE kind WHEN 'IVF_FLAT' THEN ',Flat' WHEN 'IVF_SQ8' THEN ',SQ8' ELSE ',PQ10' END,
       ' ', kind, '-', nlist, '-', l_quantity::INT), count(*) FROM y GROUP BY ALL""")
def index_label(t: Tables) -> DataFrame:
    factory = _literals(t).select(grids.factory_labels(F.col("index_params"))["full_nprobe"].alias("label"))
    kind = F.when(F.col("l_returnflag") == "A", "IVF_FLAT").when(F.col("l_returnflag") == "N", "IVF_SQ8").otherwise("IVF_PQ")
    m = F.when(kind == "IVF_PQ", "'m': 10, ").otherwise("")
    text = F.concat(
        F.lit("{'index_type': '"), kind, F.lit("', 'params': {"), m, F.lit("'nlist': "), F.col("l_linenumber") * 1000,
        F.lit("}, 'nprobe': "), F.col("l_quantity").cast("int"), F.lit("}"),
    )
    labelled = t.lineitem.select(grids.stored_labels(text).alias("p"))
    stored = labelled.select(F.concat_ws(" ", "p.index_factory", "p.index_full").alias("label"))
    count = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
    return count(factory, "factory").unionByName(count(stored, "stored"))


@query("p17_value_filters", """
SELECT p_partkey, p_type, p_size FROM part WHERE p_size <> 8 AND p_type = 'ECONOMY' AND contains(p_name, 'ring')""")
def value_filters(t: Tables) -> DataFrame:
    rows = t.part.where((F.col("p_size") != 8) & (F.col("p_type") == "ECONOMY") & F.col("p_name").contains("ring"))
    return rows.select("p_partkey", "p_type", "p_size")


@query("p18_number_text", """
SELECT o_orderkey, printf('%.2f%%', 100.0::DOUBLE * (o_totalprice / 1000000)) AS percent, printf('%.2f', o_totalprice) AS fixed2,
       printf('%.4f', o_totalprice / 7) AS fixed4, round(o_totalprice / 7, 4) AS rounded FROM orders""")
def number_text(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", reports.percent_text(price / 1_000_000).alias("percent"), reports.fixed_text(price, 2).alias("fixed2"),
        reports.fixed_text(price / 7, 4).alias("fixed4"), F.round(price / 7, 4).alias("rounded"),
    )


@query("p19_fingerprint", """
SELECT o_orderkey, md5(concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","o_orderpriority":"',
       o_orderpriority, '"}')) AS row_key FROM orders""")
def fingerprint(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", grids.fingerprint("o_orderkey", "o_orderstatus", "o_orderpriority").alias("row_key"))


@query("p21_feature_name", """
SELECT p_partkey, lower(p_type) AS base, p_size AS option, CASE WHEN p_retailprice > 950 THEN 'stat' ELSE '' END AS added FROM part""")
def feature_name(t: Tables) -> DataFrame:
    name = F.concat(F.lower("p_type"), F.lit("_"), F.col("p_size"), F.when(F.col("p_retailprice") > 950, "+stat").otherwise(""))
    return t.part.select("p_partkey", *[c.alias(n) for n, c in grids.feature_parts(name).items()])


@query("p23_random_skip", """
SELECT o_orderkey, (('0x' || substr(md5(concat('42_', o_orderkey)), 1, 8))::BIGINT % 10000 < 2500)::INT AS skipped FROM orders""")
def random_skip(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", grids.skip_at_random(F.col("o_orderkey"), 0.25).cast("int").alias("skipped"))


REPORT_SQL = """
WITH p AS (SELECT quality AS y, toxic AS y_hat FROM labels),
k AS (SELECT y AS label FROM p UNION SELECT y_hat FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE y = label AND y_hat = label) AS hits,
             (SELECT count(*) FROM p WHERE y_hat = label) AS predicted, (SELECT count(*) FROM p WHERE y = label) AS support FROM k),
m AS (SELECT label, support, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
             CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM c),
r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
a AS (SELECT label::VARCHAR AS label, precision, recall, f1, support FROM r
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                sum(f1 * support) / sum(support), sum(support) FROM r
      UNION ALL SELECT 'accuracy', avg((y = y_hat)::INT), avg((y = y_hat)::INT), avg((y = y_hat)::INT), count(*) FROM p)"""


@query("p24_described_classes", REPORT_SQL + """
SELECT CASE label WHEN '0' THEN 'queen present or original queen' WHEN '1' THEN 'queen not present' ELSE label END AS label,
       round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support::BIGINT AS support FROM a""")
def described_classes(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame(list(prep.STATUS_DESCRIPTIONS.items()), "label int, description string")
    return describe_classes(report_with_averages(t.labels, "quality", "toxic"), names)


# ---------------------------------------------------------------- windows and parameter grids


@query("g1_windows", """
SELECT s_suppkey, i AS sub_segment_no, 2 * i AS start_time, 2 * i + 7 AS end_time FROM supplier, range(27) AS r(i)""")
def windows(t: Tables) -> DataFrame:
    rows = prep.windows(t.supplier.select("s_suppkey"), 7, 5)
    return rows.select("s_suppkey", "sub_segment_no", "start_time", "end_time")


# ---------------------------------------------------------------- joins


@query("j1_prefix_join", """
WITH m AS (SELECT c_custkey, substr(c_name, 1, CASE c_mktsegment WHEN 'BUILDING' THEN 17 ELSE 18 END) AS prefix FROM customer),
f AS (SELECT o_orderkey, concat('Customer#', lpad(o_custkey::VARCHAR, 9, '0'), '__segment', o_orderkey, '.wav') AS name FROM orders)
SELECT c_custkey, o_orderkey, name FROM m JOIN f ON starts_with(name, prefix)""")
def prefix_join(t: Tables) -> DataFrame:
    length = F.when(F.col("c_mktsegment") == "BUILDING", 17).otherwise(18)
    metadata = t.customer.select("c_custkey", F.col("c_name").substr(F.lit(1), length).alias("file_name_prefix"))
    listing = t.orders.select("o_orderkey", F.format_string("Customer#%09d__segment%d.wav", "o_custkey", "o_orderkey").alias("name"))
    return prep.files_by_prefix(metadata, listing, "file_name_prefix", "name").select("c_custkey", "o_orderkey", "name")


@query("j2_match_counts", """
SELECT c_custkey, c_name, count(*) AS segments_found FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def match_counts(t: Tables) -> DataFrame:
    return prep.count_matches(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey", "o_custkey")


@query("j3_replaced_flags", """
SELECT l_linenumber, train1, count(*) AS n FROM (SELECT l_linenumber, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS train1
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey) GROUP BY ALL""")
def replaced_flags(t: Tables) -> DataFrame:
    source = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").cast("int").alias("train1")
    )
    stale = t.lineitem.select("l_orderkey", "l_linenumber").withColumn("train1", F.lit(9))
    return prep.replace_flags(stale, source, "l_orderkey", ["train1"]).groupBy("l_linenumber", "train1").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("j4_feature_lookup", """
SELECT doc_id, quality, label AS vector_label, round(list_avg(embedding::DOUBLE[]) + 1e-9, 6) AS vector_mean
FROM labels JOIN embeddings ON doc_id = vec_id""")
def feature_lookup(t: Tables) -> DataFrame:
    from vecflow.functions.vectors import mean

    stored = t.embeddings.select(
        F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("vector"), F.col("label").alias("vector_label")
    )
    joined = t.labels.join(stored, "doc_id")
    return joined.select("doc_id", "quality", "vector_label", r6(mean(F.col("vector"))).alias("vector_mean"))


@query("j7_membership_flag", """
WITH c AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, CASE WHEN c.o_custkey IS NULL THEN 0 ELSE 1 END AS urgent
FROM orders LEFT JOIN c USING (o_orderstatus, o_custkey)""")
def membership_flag(t: Tables) -> DataFrame:
    keys = ["o_orderstatus", "o_custkey"]
    chosen = t.orders.where("o_orderpriority = '1-URGENT'").select(*keys).distinct()
    return splits.flag_members(t.orders, chosen, keys, "urgent").select("o_orderkey", "urgent")


@query("j9_synced_metadata", """
WITH f AS (SELECT concat('Customer#', lpad(o_custkey::VARCHAR, 9, '0')) AS prefix, count(*) AS n FROM orders GROUP BY ALL)
SELECT c_custkey, n AS segments_found, CASE c_nationkey % 5 WHEN 0 THEN 'queen present or original queen' WHEN 1 THEN 'queen not present'
       WHEN 2 THEN 'queen present and rejected' WHEN 3 THEN 'queen present and newly accepted' ELSE '4' END AS queen_status_desc,
       isodow(ts) - 1 AS record_weekday, hour(ts) AS hour_of_day
FROM customer JOIN f ON prefix = c_name
JOIN (SELECT o_custkey, max(o_orderdate) AS ts FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def synced_metadata(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("date"))
    metadata = t.customer.join(last, "c_custkey").select(
        "c_custkey", "date", F.col("c_name").alias("file_name"), (F.col("c_nationkey") % 5).alias("queen_status")
    )
    listing = t.orders.select(F.format_string("Customer#%09d", "o_custkey").alias("name"))
    return prep.sync_metadata(metadata, listing).select(
        "c_custkey", "segments_found", "queen_status_desc", "record_weekday", "hour_of_day"
    )


# ---------------------------------------------------------------- aggregates


@query("a01_distinct_counts", """
SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS n_unique FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders""")
def distinct_counts(t: Tables) -> DataFrame:
    return prep.distinct_counts(t.orders, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("a02_smallest_class", """
SELECT min(n) AS min_groups FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus)""")
def smallest_class(t: Tables) -> DataFrame:
    return splits.minimum_class_groups(t.orders, "o_orderstatus", "o_custkey")


@query("a03_total_files", "SELECT count(*) AS files FROM orders JOIN customer ON o_custkey = c_custkey")
def total_files(t: Tables) -> DataFrame:
    counted = prep.count_matches(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")
    return counted.agg(F.sum("segments_found").alias("files"))


@query("a04_describe", """
SELECT count(v) AS valid, count(*) - count(v) AS missing, round(avg(v) + 1e-9, 6) AS mean, round(stddev_samp(v) + 1e-9, 6) AS std,
       min(v) AS min, round(quantile_cont(v, 0.25) + 1e-9, 6) AS q25, round(quantile_cont(v, 0.5) + 1e-9, 6) AS median,
       round(quantile_cont(v, 0.75) + 1e-9, 6) AS q75, max(v) AS max
FROM (SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def describe(t: Tables) -> DataFrame:
    found = prep.describe(_gappy(t), "value")
    return found.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "q25", "median", "q75")})


@query("a05_histogram", "SELECT floor(value + 0.5)::BIGINT AS bin, count(*) AS n FROM events GROUP BY bin")
def histogram(t: Tables) -> DataFrame:
    return prep.histogram(t.events, "value")


@query("a13_correlations", """
WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, CASE WHEN l_returnflag <> 'A' THEN l_tax END AS d, 1.0 AS e FROM lineitem)
SELECT n.a, n.b, round(CASE n.a || '|' || n.b
  WHEN 'quantity|price' THEN corr(x.a, x.b) WHEN 'price|quantity' THEN corr(x.a, x.b)
  WHEN 'quantity|discount' THEN corr(x.a, x.c) WHEN 'discount|quantity' THEN corr(x.a, x.c)
  WHEN 'quantity|tax' THEN corr(x.a, x.d) WHEN 'tax|quantity' THEN corr(x.a, x.d)
  WHEN 'price|discount' THEN corr(x.b, x.c) WHEN 'discount|price' THEN corr(x.b, x.c)
  WHEN 'price|tax' THEN corr(x.b, x.d) WHEN 'tax|price' THEN corr(x.b, x.d)
  WHEN 'discount|tax' THEN corr(x.c, x.d) WHEN 'tax|discount' THEN corr(x.c, x.d)
  WHEN 'quantity|quantity' THEN 1 WHEN 'price|price' THEN 1 WHEN 'discount|discount' THEN 1 WHEN 'tax|tax' THEN 1 END + 1e-9, 6) AS corr
FROM x, (SELECT p.n AS a, q.n AS b FROM (VALUES ('quantity'), ('price'), ('discount'), ('tax'), ('one')) AS p(n),
         (VALUES ('quantity'), ('price'), ('discount'), ('tax'), ('one')) AS q(n)) AS n GROUP BY n.a, n.b""")
def correlations(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("tax"), F.lit(1.0).alias("one"),
    )
    return prep.correlations(lines, lines.columns).withColumn("corr", r6(F.col("corr")))


@query("a14_value_shares", """
WITH r AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
c AS (SELECT 'all' AS subset, v AS value, count(*) AS n FROM r GROUP BY v
      UNION ALL SELECT 'top1', v, count(*) FROM r WHERE rn <= 50 GROUP BY v
      UNION ALL SELECT 'top2', v, count(*) FROM r WHERE rn <= 100 GROUP BY v)
SELECT subset, value, n, round(n / sum(n) OVER (PARTITION BY subset) + 1e-9, 6) AS share,
       (row_number() OVER (PARTITION BY subset ORDER BY n DESC, value DESC) = 1)::INT AS is_most_frequent FROM c""")
def value_shares(t: Tables) -> DataFrame:
    found = reports.value_shares(t.orders, "o_orderpriority", "o_totalprice", "o_orderkey", 50, 100)
    return found.withColumn("share", r6(F.col("share")))


@query("a15_two_levels", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority)::INT AS is_total
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))""")
def two_levels(t: Tables) -> DataFrame:
    return reports.two_level_counts(t.orders, "o_orderstatus", "o_orderpriority")


@query("a16_group_measures", """
SELECT l_returnflag, min(l_quantity) AS quantity_min, round(avg(l_quantity) + 1e-9, 6) AS quantity_mean, max(l_quantity) AS quantity_max,
       min(l_extendedprice) AS price_min, round(avg(l_extendedprice) + 1e-9, 4) AS price_mean, max(l_extendedprice) AS price_max
FROM lineitem GROUP BY l_returnflag""")
def group_measures(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    found = reports.group_measures(lines, "l_returnflag", ["quantity", "price"])
    return found.withColumns({"quantity_mean": r6(F.col("quantity_mean")), "price_mean": F.round(F.col("price_mean") + 1e-9, 4)})


@query("a17_first_valid", """
SELECT l_returnflag, l_linestatus, arg_min(l_quantity, k) AS l_quantity, arg_min(l_tax, k) FILTER (l_tax IS NOT NULL) AS l_tax
FROM (SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_tax > 0.02 THEN l_tax END AS l_tax,
             concat_ws('_', strftime(l_shipdate, '%Y-%m-%d'), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
GROUP BY ALL""")
def first_valid(t: Tables) -> DataFrame:
    order = F.concat_ws("_", F.date_format("l_shipdate", "yyyy-MM-dd"), *LINE_KEY)
    lines = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_quantity", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("l_tax"), order.alias("k")
    )
    return ranking.first_valid_by_key(lines, ["l_returnflag", "l_linestatus"], "k")


@query("a18_result_statistics", """
WITH r AS (SELECT o_totalprice AS p, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT count(*) AS n, max(p) AS max, round(avg(p) + 1e-9, 4) AS mean, min(p) AS min,
       round(avg(p) FILTER (rn <= 50) + 1e-9, 4) AS mean_top1, min(p) FILTER (rn <= 50) AS min_top1,
       round(avg(p) FILTER (rn <= 100) + 1e-9, 4) AS mean_top2, min(p) FILTER (rn <= 100) AS min_top2 FROM r""")
def result_statistics(t: Tables) -> DataFrame:
    found = reports.result_statistics(t.orders, "o_totalprice", "o_orderkey", 50, 100)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean", "mean_top1", "mean_top2")})


@query("a19_measure_means", """
WITH r AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 500)
SELECT p_type, round(avg(p_size) + 1e-9, 6) AS p_size_mean, round(avg(p_retailprice) + 1e-9, 4) AS p_retailprice_mean
FROM r WHERE p_type IN ('ECONOMY', 'STANDARD') GROUP BY p_type""")
def measure_means(t: Tables) -> DataFrame:
    best = reports.best_configurations(t.part, 500, "p_retailprice", "p_partkey")
    found = reports.measure_means(best, "p_type", ["p_size", "p_retailprice"], ["ECONOMY", "STANDARD"])
    return found.withColumns({
        "p_size_mean": r6(F.col("p_size_mean")), "p_retailprice_mean": F.round(F.col("p_retailprice_mean") + 1e-9, 4)
    })


# ---------------------------------------------------------------- order, limits, sets


@query("w2_changed_scores", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN floor(value) END AS score FROM events),
p AS (SELECT *, coalesce(lag(score) OVER (ORDER BY score DESC NULLS FIRST, event_id), 0) AS previous FROM e)
SELECT event_id, score::BIGINT AS score FROM p WHERE score IS DISTINCT FROM previous""")
def changed_scores(t: Tables) -> DataFrame:
    scored = t.events.select("event_id", F.when(F.col("event_id") % 97 != 0, F.floor("value")).alias("score"))
    return ranking.drop_unchanged(scored, "score", "event_id")


@query("w4_every_nth", """
SELECT event_id, strftime(ts, '%d %b %H:%M') AS tick FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts,
  row_number() OVER (ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END NULLS FIRST, event_id) AS rn FROM events)
WHERE (rn - 1) % 70 = 0""")
def every_nth(t: Tables) -> DataFrame:
    events = t.events.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return ranking.every_nth(events, "ts", "event_id", 70).select("event_id", prep.tick_label(F.col("ts")).alias("tick"))


@query("t1_sorted", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS ordinal FROM part")
def sorted_rows(t: Tables) -> DataFrame:
    return ranking.with_ordinal(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("t2_sorted_results", """
WITH r AS (SELECT o_orderkey, round(o_totalprice / 1000) AS accuracy, o_orderpriority AS feature, o_orderstatus AS vector_operation FROM orders)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, feature, vector_operation, o_orderkey) - 1 AS ordinal FROM r""")
def sorted_results(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("accuracy"), F.col("o_orderpriority").alias("feature"),
        F.col("o_orderstatus").alias("vector_operation"),
    )
    rows = reports.sorted_results(rows).withColumn("ties", F.struct("feature", "vector_operation", "o_orderkey"))
    return ranking.with_ordinal(rows, "accuracy", "ties", descending=True).drop("ties")


@query("t3_best_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def best_rows(t: Tables) -> DataFrame:
    return reports.best_configurations(t.orders.select("o_orderkey", "o_totalprice"), 20, "o_totalprice", "o_orderkey")


@query("t4_first_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""")
def first_rows(t: Tables) -> DataFrame:
    return ranking.top_n(t.lineitem.select(*LINE_KEY), 1000, *[F.col(c) for c in LINE_KEY])


@query("u1_union_by_name", """
SELECT c_nationkey AS nationkey, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier""")
def union_by_name(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    return files.union_all([customers, suppliers])


@query("u2_all_overlaps", """
SELECT s_suppkey, 0 AS overlap, 10 * i AS start_time FROM supplier, range(6) AS r(i)
UNION ALL SELECT s_suppkey, 5, 5 * i FROM supplier, range(11) AS r(i)""")
def all_overlaps(t: Tables) -> DataFrame:
    return files.all_overlaps(_segment_table(t), 10, "all").select("s_suppkey", "overlap", "start_time")


@query("u3_stacked_arrays", """
SELECT vec_id, len(v) AS n, round(list_sum(v) + 1e-9, 6) AS total
FROM (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS v FROM embeddings)""")
def stacked_arrays(t: Tables) -> DataFrame:
    from vecflow.functions.vectors import combine

    v = doubles(F.col("embedding"))
    stacked = t.embeddings.select("vec_id", combine(v, F.transform(v, F.abs)).alias("v"))
    return stacked.select("vec_id", F.size("v").alias("n"), r6(array_sum(F.col("v"))).alias("total"))


