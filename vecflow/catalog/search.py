"""Queries on nearest-neighbour search, votes, indexes and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecflow.catalog.registry import SCALED_SQL, SPLIT_SQL, Tables, embedded, hits_sql, query, r6
from vecflow.catalog.tables import REPORT_SQL
from vecflow.functions.vectors import doubles
from vecflow.operators import evaluation, indexes, neighbors, prep, reports, votes
from vecflow.plans import datagrid, experiments, grids, records
from vecflow.session import scratch_path, shared_dir
from vecflow.sources import files, stores


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return experiments.train_and_test(embedded(t), "vec_id", "v", "label")


def _hits(t: Tables, k: int = 15, metric: str = "cosine") -> DataFrame:
    train, test = _sides(t)
    return neighbors.exact_topk(test, train, k, metric)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "neighbor_id", "label", r6(F.col("distance")).alias("distance"))


HITS_SQL = "WITH " + SPLIT_SQL + "," + hits_sql("s", 15)
ROWS_SQL = " SELECT query_id, rank::INT AS rank, neighbor_id, label, round(distance + 1e-9, 6) AS distance FROM h"

METRIC_SQL = {
    "cosine": "1 - list_cosine_similarity(q.v, t.v)",
    "correlation": "1 - list_cosine_similarity(list_transform(q.v, lambda x: x - list_avg(q.v)), "
                   "list_transform(t.v, lambda x: x - list_avg(t.v)))",
    "l2": "list_sum(list_transform(q.v, lambda x, i: (x - t.v[i]) * (x - t.v[i])))",
    "euclidean": "list_distance(q.v, t.v)",
    "manhattan": "list_sum(list_transform(q.v, lambda x, i: abs(x - t.v[i])))",
    "inner_product": "-list_dot_product(q.v, t.v)",
}


def _register_metric(metric: str) -> None:
    sql = "WITH " + SPLIT_SQL + "," + hits_sql("s", 15, METRIC_SQL[metric]) + ROWS_SQL

    @query(f"k01_exact_{metric}", sql)
    def exact(t: Tables) -> DataFrame:
        return _rounded(_hits(t, 15, metric))


for _metric in METRIC_SQL:
    _register_metric(_metric)


@query("k01_supplier_lines", """
WITH t AS (SELECT l_orderkey * 8 + l_linenumber AS line, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount * 10 AS c, l_tax * 12 AS d FROM lineitem),
u AS (SELECT line, min(a) AS a, min(b) AS b, min(c) AS c, min(d) AS d FROM t GROUP BY line),
q AS (SELECT l_suppkey, avg(l_quantity) / 50 AS a, avg(l_extendedprice) / 100000 AS b, avg(l_discount) * 10 AS c, avg(l_tax) * 12 AS d FROM lineitem GROUP BY l_suppkey),
x AS (SELECT l_suppkey AS query_id, line AS neighbor_id, (q.a-u.a)*(q.a-u.a) + (q.b-u.b)*(q.b-u.b) + (q.c-u.c)*(q.c-u.c) + (q.d-u.d)*(q.d-u.d) AS distance FROM q, u)
SELECT query_id, rank::INT AS rank, round(distance + 1e-9, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM x) WHERE rank <= 15""")
def supplier_lines(t: Tables) -> DataFrame:
    """The line items nearest to each supplier's mean line: few queries, many train rows."""
    parts = {"l_quantity": 1 / 50, "l_extendedprice": 1 / 100_000, "l_discount": 10.0, "l_tax": 12.0}
    lines = t.lineitem.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")).agg(
        F.array(*[F.min(F.col(c) * w) for c, w in parts.items()]).alias("v")
    )
    means = t.lineitem.groupBy("l_suppkey").agg(F.array(*[F.avg(c) * w for c, w in parts.items()]).alias("v"))
    hits = neighbors.exact_topk(
        neighbors.as_vectors(means, "l_suppkey", "v"), neighbors.as_vectors(lines, "line", "v"), 15, "l2"
    )
    return hits.select("query_id", "rank", r6(F.col("distance")).alias("distance"))


@query("w1_top_k_all", """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, list_distance(q.v, t.v) AS distance FROM s q, s t WHERE q.vec_id <> t.vec_id)
SELECT query_id, rank::INT AS rank, neighbor_id, round(distance + 1e-9, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 5""")
def top_k_all(t: Tables) -> DataFrame:
    rows = neighbors.as_vectors(t.embeddings, "vec_id", "embedding", "label")
    hits = neighbors.exact_topk(rows, rows, 5, "euclidean", skip_same=True)
    return hits.select("query_id", "rank", "neighbor_id", r6(F.col("distance")).alias("distance"))


@query("w3_rank_scores", HITS_SQL + """
SELECT query_id, label, round(sum(1.0 / rank) + 1e-9, 6) AS score FROM h WHERE rank <= 5 GROUP BY ALL""")
def rank_scores(t: Tables) -> DataFrame:
    hits = _hits(t, 5)
    return hits.groupBy("query_id", "label").agg(r6(F.sum(1.0 / F.col("rank"))).alias("score"))


# ---------------------------------------------------------------- votes

MAJORITY_SQL = """
, c AS (SELECT query_id, label, count(*) AS n FROM h GROUP BY ALL),
p AS (SELECT query_id, label AS prediction, n,
             row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS rn FROM c)"""


@query("k02_majority_vote", HITS_SQL + MAJORITY_SQL + " SELECT query_id, prediction FROM p WHERE rn = 1")
def majority_vote(t: Tables) -> DataFrame:
    return votes.predict(_hits(t), "uniform")


@query("k03_vote_share", HITS_SQL + MAJORITY_SQL + " SELECT query_id, prediction, round(n / 15 + 1e-9, 6) AS score FROM p WHERE rn = 1")
def vote_share(t: Tables) -> DataFrame:
    return votes.majority(_hits(t)).withColumn("score", r6(F.col("score")))


def weighted_sql(weight: str) -> str:
    return f"""
, c AS (SELECT query_id, label, round(sum({weight}), 6) AS w FROM h GROUP BY ALL)
SELECT query_id, label AS prediction
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) AS rn FROM c) WHERE rn = 1"""


@query("k04_weighted_vote", HITS_SQL + weighted_sql("1 / (distance + 1e-6)"))
def weighted_vote(t: Tables) -> DataFrame:
    return votes.predict(_hits(t), "distance")


@query("k04_raw_score_vote", HITS_SQL + weighted_sql("1 / ((1 - distance) + 1e-6)"))
def raw_score_vote(t: Tables) -> DataFrame:
    return votes.weighted(_hits(t), "raw_score")


SCALED_HITS_SQL = "WITH " + SCALED_SQL + "," + hits_sql("z", 20, METRIC_SQL["correlation"])


@query("k05_classifier_uniform", SCALED_HITS_SQL + MAJORITY_SQL + """
SELECT p.query_id, y, prediction AS y_hat FROM p JOIN (SELECT DISTINCT query_id, y FROM h) USING (query_id) WHERE rn = 1""")
def classifier_uniform(t: Tables) -> DataFrame:
    train, test = _sides(t)
    return experiments.classify(train, test, "correlation", 20, "uniform")


@query("k05_classifier_inverse", SCALED_HITS_SQL + weighted_sql("1 / distance"))
def classifier_inverse(t: Tables) -> DataFrame:
    train, test = experiments.scaled(*_sides(t))
    return votes.weighted(neighbors.exact_topk(test, train, 20, "correlation"), "inverse")


VALIDITY_SQL = """
, vd AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS rank
         FROM s a, s b WHERE a.train1 = 1 AND b.train1 = 1 AND a.vec_id <> b.vec_id),
val AS (SELECT vec_id, count(*) FILTER (other = label) / 15 AS validity FROM vd WHERE rank <= 15 GROUP BY vec_id)"""


@query("k06_validity", "WITH " + SPLIT_SQL + VALIDITY_SQL + " SELECT vec_id AS id, round(validity + 1e-9, 6) AS validity FROM val")
def validity(t: Tables) -> DataFrame:
    train, _ = _sides(t)
    return votes.validity(train, 15).withColumn("validity", r6(F.col("validity")))


@query("k06_validity_in_index", "WITH " + SPLIT_SQL + VALIDITY_SQL + " SELECT vec_id AS id, round(validity + 1e-9, 6) AS validity FROM val")
def validity_in_index(t: Tables) -> DataFrame:
    """The same by an inverted index, with as many probes as cells."""
    train, _ = _sides(t)
    index = indexes.build_index(train, "IVF8,Flat")
    scores = votes.validity(train, 15, search=lambda rows, k: indexes.search_index(index, rows, k, nprobe=8))
    return scores.withColumn("validity", r6(F.col("validity")))


@query("k07_validity_vote", HITS_SQL + VALIDITY_SQL + """
, m AS (SELECT h.query_id, h.label, h.rank, validity >= 0.2 AS ok FROM h JOIN val ON val.vec_id = h.neighbor_id),
o AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS has_valid FROM m),
c AS (SELECT query_id, label, count(*) AS n, min(rank) AS first_rank, max(has_valid::INT) AS hv FROM o WHERE ok OR NOT has_valid GROUP BY query_id, label),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_rank) AS rn,
             CASE WHEN hv = 1 THEN sum(n) OVER (PARTITION BY query_id) ELSE 0 END AS total FROM c)
SELECT query_id, label AS prediction, total::BIGINT AS valid_neighbors FROM b WHERE rn = 1""")
def validity_vote(t: Tables) -> DataFrame:
    train, test = _sides(t)
    hits = neighbors.exact_topk(test, train, 15)
    return votes.with_validity(hits, votes.validity(train, 15), 0.2)


ONE_VS_REST_SQL = """
, c AS (SELECT query_id, label, count(*) AS n, round(avg(distance), 9) AS md, count(*) * 2 > {k} AS yes FROM h WHERE rank <= {k} GROUP BY query_id, label),
o AS (SELECT *, sum(yes::INT) OVER (PARTITION BY query_id) AS yeses, row_number() OVER (PARTITION BY query_id
      ORDER BY yes DESC, CASE WHEN yes THEN md ELSE -n END, label) AS rn FROM c)
SELECT query_id, label AS prediction, yeses::BIGINT AS yes_classes FROM o WHERE rn = 1"""


@query("k08_one_vs_rest", HITS_SQL + ONE_VS_REST_SQL.format(k=15))
def one_vs_rest(t: Tables) -> DataFrame:
    return votes.one_vs_rest(_hits(t), 15)


@query("k08_one_vs_rest_near", HITS_SQL + ONE_VS_REST_SQL.format(k=3))
def one_vs_rest_near(t: Tables) -> DataFrame:
    return votes.one_vs_rest(_hits(t, 3), 3)


@query("k09_table_search", HITS_SQL + """
SELECT query_id, rank::INT AS rank, neighbor_id, h.label, concat('vec_', h.hit_grp, '_', neighbor_id) AS sub_segment_name FROM h""")
def table_search(t: Tables) -> DataFrame:
    name = "vecflow_k09"
    stores.create_collection(
        t.spark, name, "COSINE", stores.index_text("IVF_FLAT", {"nlist": 8}), recreate=True, location=scratch_path(t.spark, name),
        columns="id bigint, vector_data array<double>, label int, sub_segment_name string",
    )
    rows = embedded(t)
    stored = rows.where("train1 = 1").select(
        F.col("vec_id").alias("id"), F.col("v").alias("vector_data"), "label",
        F.concat_ws("_", F.lit("vec"), "grp", "vec_id").alias("sub_segment_name"),
    )
    stores.insert_records(stored, name)
    stores.build_collection_index(t.spark, name)
    asked = neighbors.as_vectors(rows.where("train1 = 0"), "vec_id", "v", "label")
    found = stores.search_collection(asked, name, 15, nprobe=8, fields=["sub_segment_name"])  # all cells: equals exact
    return found.select("query_id", "rank", "neighbor_id", "label", "sub_segment_name")


RECIPROCAL_SQL = """
, c AS (SELECT query_id, label, round(sum(1.0::DOUBLE / rank), 9) AS score, min(rank) AS first_rank FROM h WHERE rank <= 5 GROUP BY query_id, label),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rn FROM c)"""


@query("k10_reciprocal_rank", HITS_SQL + RECIPROCAL_SQL + """
SELECT query_id, label AS prediction, round(score + 1e-9, 6) AS score FROM p WHERE rn = 1""")
def reciprocal_rank(t: Tables) -> DataFrame:
    return votes.reciprocal_rank(_hits(t, 5)).withColumn("score", r6(F.col("score")))


@query("k11_nearest", HITS_SQL + """
SELECT query_id, neighbor_id, label, round(distance + 1e-9, 6) AS distance FROM h WHERE rank = 1""")
def nearest(t: Tables) -> DataFrame:
    train, test = _sides(t)
    found = neighbors.nearest(test, train)
    return found.select("query_id", "neighbor_id", "label", r6(F.col("distance")).alias("distance"))


@query("j5_neighbor_labels", HITS_SQL + " SELECT label, count(*) AS n FROM h GROUP BY label")
def neighbor_labels(t: Tables) -> DataFrame:
    return _hits(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("j6_hit_fields", HITS_SQL + " SELECT query_id, rank::INT AS rank, neighbor_id, hit_grp AS grp FROM h WHERE rank <= 5")
def hit_fields(t: Tables) -> DataFrame:
    found = neighbors.with_fields(_hits(t, 5), embedded(t), "vec_id", ["grp"])
    return found.select("query_id", "rank", "neighbor_id", "grp")


@query("x6_vote_function", HITS_SQL + MAJORITY_SQL + " SELECT query_id, prediction FROM p WHERE rn = 1")
def vote_function(t: Tables) -> DataFrame:
    from vecflow.operators.partitions import register_majority

    vote = register_majority(t.spark)
    lists = _hits(t).groupBy("query_id").agg(F.collect_list("label").alias("labels"))  # k labels per query
    return lists.select("query_id", F.expr(f"{vote}(labels)").alias("prediction"))


# ---------------------------------------------------------------- indexes


def _indexed(t: Tables, spec: str, build: dict, search: dict, metric: str = "cosine") -> DataFrame:
    train, test = _sides(t)
    index = indexes.build_index(train, spec, metric, **build)
    return _rounded(indexes.search_index(index, test, 15, **search))


# with as many probes as cells the inverted search must equal the exact one
@query("k12_ivf_all_cells", HITS_SQL + ROWS_SQL)
def ivf_all_cells(t: Tables) -> DataFrame:
    return _indexed(t, "IVF16,Flat", {}, {"nprobe": 16})


@query("k12_ivf_probes")
def ivf_probes(t: Tables) -> DataFrame:
    return _indexed(t, "IVF16,Flat", {}, {"nprobe": 4})


SQ8_SQL = "WITH " + SPLIT_SQL + """,
un AS (SELECT vec_id, label, grp, train1, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s),
mm AS (SELECT i, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM un WHERE train1 = 1) GROUP BY i),
ml AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM mm),
cq AS (SELECT un.vec_id, un.label, un.grp, un.train1, CASE WHEN train1 = 0 THEN un.v ELSE list_transform(un.v, lambda x, i:
       ml.lo[i] + (least(255, greatest(0, floor(255 * ((x - ml.lo[i]) / (ml.hi[i] - ml.lo[i]))))) + 0.5::DOUBLE) / 255 * (ml.hi[i] - ml.lo[i])) END AS v FROM un, ml),"""


@query("k13_scalar_quantised", SQ8_SQL + hits_sql("cq", 15, "1 - list_dot_product(q.v, t.v)") + ROWS_SQL)
def scalar_quantised(t: Tables) -> DataFrame:
    return _indexed(t, "SQ8", {}, {})


@query("k13_ivf_scalar_quantised", SQ8_SQL + hits_sql("cq", 15, "1 - list_dot_product(q.v, t.v)") + ROWS_SQL)
def ivf_scalar_quantised(t: Tables) -> DataFrame:
    return _indexed(t, "IVF8,SQ8", {}, {"nprobe": 8})


# a half has 11 significant bits, and below 2^-14 steps of 2^-24; halves of a step go to the even neighbour
HALF_SQL = "WITH " + SPLIT_SQL + """,
un AS (SELECT vec_id, label, grp, train1, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s),
cq AS (SELECT vec_id, label, grp, train1, CASE WHEN train1 = 0 THEN v ELSE list_transform(v, lambda x: CASE WHEN x = 0 THEN x ELSE
       round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END) END AS v FROM un),"""


@query("k14_half_precision", HALF_SQL + hits_sql("cq", 15, "1 - list_dot_product(q.v, t.v)") + ROWS_SQL)
def half_precision(t: Tables) -> DataFrame:
    return _indexed(t, "SQfp16", {}, {})


@query("k15_product_quantised")
def product_quantised(t: Tables) -> DataFrame:
    return _indexed(t, "PQ8", {"nbits": 4}, {})


@query("k15_ivf_product_quantised")
def ivf_product_quantised(t: Tables) -> DataFrame:
    return _indexed(t, "IVF8,PQ4", {"nbits": 4}, {"nprobe": 8})


def _quality(train: DataFrame, test: DataFrame, exact: DataFrame, spec: str, build: dict, nprobe: int, floor: float) -> DataFrame:
    """One row on an index whose centres or codebooks are fitted: its hits against the exact ones.

    ``bad_lists`` counts queries whose hits are not 15 different rows in order of distance; ``close`` says whether the share of
    exact hits found reaches the floor. The hits are checkpointed, as both read them.
    """
    hits = indexes.search_index(indexes.build_index(train, spec, **build), test, 15, nprobe).checkpoint()
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance"))), lambda h: h["distance"])
    lists = hits.groupBy("query_id").agg(F.count_distinct("neighbor_id").alias("n"), order.alias("distances"))
    bad = (F.col("n") != 15) | ~F.forall(
        F.sequence(F.lit(1), F.size("distances") - 1), lambda i: F.get("distances", i) >= F.get("distances", i - 1)
    )
    share = exact.select("query_id", "neighbor_id").join(hits.select("query_id", "neighbor_id", F.lit(1).alias("f")), ["query_id", "neighbor_id"], "left")
    found = share.agg((F.count("f") / F.count("*")).alias("recall"))
    rows = lists.agg(F.count("*").alias("queries"), F.count_if(bad).alias("bad_lists"))
    both = rows.unionByName(found, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("queries", "bad_lists", "recall")))
    return both.select(F.lit(spec).alias("spec"), "queries", "bad_lists", (F.col("recall") >= floor).cast("int").alias("close"))


QUALITY = [("IVF16,Flat", {}, 4, 0.45), ("PQ8", {"nbits": 4}, 1, 0.3), ("IVF8,PQ4", {"nbits": 4}, 8, 0.15)]


@query("k15_index_quality", "WITH " + SPLIT_SQL + " SELECT spec, count(*) AS queries, 0 AS bad_lists, 1 AS close FROM s, (VALUES "
       + ", ".join(f"('{spec}')" for spec, *_ in QUALITY) + ") AS t(spec) WHERE train1 = 0 GROUP BY spec")
def index_quality(t: Tables) -> DataFrame:
    """Split and exact hits are the same for all indexes: made once and checkpointed."""
    shared_dir(t.spark)
    train, test = (side.checkpoint() for side in _sides(t))
    exact = neighbors.exact_topk(test, train, 15).checkpoint()
    return files.union_all([_quality(train, test, exact, *one) for one in QUALITY])


def _build_configurations(t: Tables) -> DataFrame:
    """Line items read as index configurations: cells by line number, storage by flag, probes by quantity."""
    storage = F.when(F.col("l_returnflag") == "A", "Flat").when(F.col("l_returnflag") == "N", "SQ8").otherwise("PQ10")
    return t.lineitem.select(
        F.concat(F.lit("IVF"), F.col("l_linenumber") * 1000, F.lit(","), storage).alias("index_factory"),
        F.col("l_quantity").cast("int").alias("nprobe"),
        F.struct("l_quantity", "l_orderkey", "l_linenumber").alias("n"),
    )


@query("k18_distinct_builds", """
SELECT concat('IVF', l_linenumber * 1000, ',', CASE l_returnflag WHEN 'A' THEN 'Flat' WHEN 'N' THEN 'SQ8' ELSE 'PQ10' END) AS index_factory,
       min(l_quantity)::INT AS nprobe FROM lineitem GROUP BY ALL""")
def distinct_builds(t: Tables) -> DataFrame:
    return experiments.distinct_builds(_build_configurations(t), ["index_factory"], "n")


@query("k17_rebuilt_index", HITS_SQL + ROWS_SQL)
def rebuilt_index(t: Tables) -> DataFrame:
    """Builds, saves, rebuilds with other parameters under another key, loads and searches."""
    train, test = _sides(t)
    root = scratch_path(t.spark, "indexes")
    for spec in ("IVF4,Flat", "IVF8,Flat"):
        key = f"embeddings-train1-{spec.replace(',', '-')}-cosine"
        indexes.cached_index(train, spec, "cosine", root, key)
    kept = indexes.cached_index(train, "IVF8,Flat", "cosine", root, "embeddings-train1-IVF8-Flat-cosine")
    return _rounded(indexes.search_index(kept, test, 15, nprobe=8))


@query("s18_filled_collections", "WITH " + SCALED_SQL + """,
c AS (SELECT count(*) AS n, round(sum(list_sum(v)) + 1e-9, 6) AS total FROM z WHERE train1 = 1)
SELECT 'vecflow_s18_cosine' AS collection, n, total FROM c UNION ALL SELECT 'vecflow_s18_l2', n, total FROM c""")
def filled_collections(t: Tables) -> DataFrame:
    train, _ = _sides(t)

    def create(configuration: dict) -> str:
        name = f"vecflow_s18_{configuration['metric']}"
        return stores.create_collection(
            t.spark, name, configuration["metric"], "Flat", recreate=True, location=scratch_path(t.spark, name),
            columns="id bigint, vector_data array<double>, label int",
        )

    insert = lambda df, name: stores.insert_records(df.withColumnRenamed("vector", "vector_data"), name)
    names = experiments.fill_collections([{"metric": "cosine"}, {"metric": "l2"}], lambda c: train, create, insert)
    totals = [
        t.spark.table(n).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.aggregate("vector_data", F.lit(0.0), lambda a, x: a + x))).alias("total"))
        .withColumn("collection", F.lit(n)) for n in names
    ]
    return files.union_all(totals)


# ---------------------------------------------------------------- evaluation


@query("e01_accuracy", "SELECT round(avg((quality = toxic)::INT) + 1e-9, 6) AS accuracy, count(*) AS n FROM labels")
def accuracy(t: Tables) -> DataFrame:
    return evaluation.accuracy(t.labels, "quality", "toxic").withColumn("accuracy", r6(F.col("accuracy")))


@query("e02_confusion", """
WITH k AS (SELECT quality AS label FROM labels UNION SELECT toxic FROM labels)
SELECT a.label AS y, b.label AS y_hat, count(quality) AS n
FROM k a CROSS JOIN k b LEFT JOIN labels ON quality = a.label AND toxic = b.label GROUP BY ALL""")
def confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(t.labels, "quality", "toxic")


@query("e03_class_report", REPORT_SQL + """
SELECT label, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, round(f1 + 1e-9, 6) AS f1,
       support::BIGINT AS support FROM a""")
def class_report(t: Tables) -> DataFrame:
    report = evaluation.report_with_averages(t.labels, "quality", "toxic")
    return report.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query("e04_result_row", REPORT_SQL + """
SELECT round((SELECT recall FROM a WHERE label = 'accuracy') + 1e-9, 6) AS accuracy, (SELECT count(*) FROM labels) AS testing_set_size,
       round((SELECT precision FROM a WHERE label = '0') + 1e-9, 6) AS precision_0,
       round((SELECT precision FROM a WHERE label = '1') + 1e-9, 6) AS precision_1, NULL::DOUBLE AS precision_2, 0 AS skipped""")
def result_row(t: Tables) -> DataFrame:
    row = evaluation.flat_result(t.labels, "quality", "toxic", [0, 1, 2])
    rounded = {c: r6(F.col(c)) for c in ("accuracy", "precision_0", "precision_1")}
    return row.withColumns(rounded).withColumn("skipped", F.col("skipped").cast("int"))


# precision_0 ... precision_3
PRECISIONS_SQL = ", ".join(
    f"round(coalesce(count(*) FILTER (y = label AND label = {c}) / nullif(count(*) FILTER (label = {c}), 0), "
    f"CASE WHEN count(*) FILTER (y = {c}) > 0 THEN 0 END) + 1e-9, 6) AS precision_{c}" for c in range(4)
)


def _recorded(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows of a grid with all their fields, and the predictions behind them: exact, by an index, and three that can't be run."""
    base = {"segment_lenght": 3, "segment_overlap": 0, "feature": "embedding", "vector_operation": "none", "metric_type": "cosine", "vote_type": "uniform"}
    rows = [
        {**base, "row_key": f"{m}-{v}-{k}", "metric_type": m, "vote_type": v, "neighbors": k}
        for m in ("cosine", "correlation") for v in ("uniform", "distance") for k in (15, 20)
    ]
    rows += [{**base, "row_key": "ivf-15", "index_params": "{'params': 'IVF8,Flat', 'nprobe': 8, 'neighbors': 15}"}]
    rows += [{**base, "row_key": "bad-index", "neighbors": 15, "index_params": "{'params': 'HNSW32,Flat'}"}]
    rows += [{**base, "row_key": "bad-text", "neighbors": 15, "index_params": "IVF("}, {**base, "row_key": "bad-k", "neighbors": 0}]
    return records.run_recorded(*_sides(t), rows)


def _recorded_sql() -> str:
    return GRID_CTES + f"""
, r AS (SELECT concat(m, '-', vote, '-', k) AS row_key, m, vote, k, y, label FROM p WHERE rn = 1
  UNION ALL SELECT 'ivf-15', m, vote, k, y, label FROM p WHERE rn = 1 AND m = 'cosine' AND vote = 'uniform' AND k = 15)
SELECT row_key, 3 AS segment_lenght, 0 AS segment_overlap, 'embedding' AS feature, 'none' AS vector_operation, m AS metric_type, vote AS vote_type, k AS neighbors,
       CASE WHEN row_key = 'ivf-15' THEN '{{''params'': ''IVF8,Flat'', ''nprobe'': 8, ''neighbors'': 15}}' END AS index_params, 0 AS skipped,
       round(avg((y = label)::INT) + 1e-9, 6) AS accuracy, {PRECISIONS_SQL}, (SELECT count(*) FROM s WHERE train1 = 1) AS training_set_size,
       count(*) AS testing_set_size, 4 AS measured FROM r GROUP BY row_key, m, vote, k
UNION ALL SELECT 'bad-' || b, 3, 0, 'embedding', 'none', 'cosine', 'uniform', n, i, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0
FROM (VALUES ('index', 15, '{{''params'': ''HNSW32,Flat''}}'), ('text', 15, 'IVF('), ('k', 0, NULL)) AS b(b, n, i)"""


PROVENANCE_SQL = HITS_SQL + RECIPROCAL_SQL + """
, b AS (SELECT query_id, label AS prediction FROM p WHERE rn = 1),
f AS (SELECT query_id, y, grp, max(label) FILTER (rank = 1) AS first_label, max(hit_grp) FILTER (rank = 5) AS hit_grp,
             max(hit_grp // 5) FILTER (rank = 5) AS hit_set FROM h WHERE rank <= 5 GROUP BY query_id, y, grp),
x AS (SELECT *, grp // 5 AS own_set FROM f JOIN b USING (query_id))
SELECT count(*) AS queries, count(*) FILTER (prediction = y) AS correct, count(*) FILTER (first_label = y) AS first_correct,
       count(*) FILTER (first_label = y AND hit_grp = grp) AS same_file, count(*) FILTER (first_label = y AND hit_set = own_set) AS same_group,
       count(*) FILTER (hit_set <> own_set) AS isolated, count(*) FILTER (first_label = y AND hit_set <> own_set) AS isolated_correct,
       round(count(*) FILTER (first_label = y AND hit_set <> own_set) / greatest(count(*) FILTER (hit_set <> own_set), 1) + 1e-9, 6) AS isolated_accuracy
FROM x"""


@query("e05_provenance", PROVENANCE_SQL)
def provenance(t: Tables) -> DataFrame:
    rows = embedded(t)
    names = rows.select("vec_id", "label", F.concat_ws("_", F.lit("set"), F.expr("grp div 5"), F.lit("file"), "grp", "vec_id").alias("name"))
    keys = prep.name_keys(F.col("name"))
    named = names.select("vec_id", "label", keys["file_key"].alias("file"), keys["group_key"].alias("group"))
    hits = _hits(t, 5)
    hit_keys = named.select(F.col("vec_id").alias("neighbor_id"), F.col("file").alias("f"), F.col("group").alias("g"))
    seen = hits.join(hit_keys, "neighbor_id").groupBy("query_id").agg(
        F.min_by("label", "rank").alias("first_label"), F.max_by("f", "rank").alias("hit_file"), F.max_by("g", "rank").alias("hit_group")
    )
    own = named.select(F.col("vec_id").alias("query_id"), F.col("label").alias("y"), "file", "group")
    joined = seen.join(votes.reciprocal_rank(hits), "query_id").join(own, "query_id")
    return evaluation.provenance(joined).withColumn("isolated_accuracy", r6(F.col("isolated_accuracy")))


FOLD_SQL = """
WITH g AS (SELECT DISTINCT label, vec_id // 10 AS grp FROM embeddings),
rk AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42_', grp)), grp) AS rn, count(*) OVER (PARTITION BY label) AS n FROM g),
fd AS (SELECT label, grp, (CASE WHEN rn - 1 < (n % 4) * (n // 4 + 1) THEN (rn - 1) // (n // 4 + 1)
              ELSE n % 4 + (rn - 1 - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END)::INT AS fold FROM rk),
e AS (SELECT vec_id, e.label, embedding::DOUBLE[] AS v, fold FROM embeddings e JOIN fd ON e.label = fd.label AND vec_id // 10 = grp),
fl AS (SELECT unnest([0, 1, 2, 3]) AS f),
x AS (SELECT f, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e, fl WHERE fold <> f),
mm AS (SELECT f, i, min(x) AS lo, max(x) AS hi FROM x GROUP BY f, i),
ml AS (SELECT f, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM mm GROUP BY f),
z AS (SELECT f, vec_id, label, fold, list_transform(v, lambda x, i: (x - lo[i]) / CASE WHEN hi[i] = lo[i] THEN 1 ELSE hi[i] - lo[i] END) AS v FROM e, ml),
d AS (SELECT q.f, q.vec_id AS query_id, q.label AS y, t.vec_id AS nid, t.label, 1 - list_cosine_similarity(q.v, t.v) AS distance
      FROM z q JOIN z t ON q.f = t.f WHERE q.fold = q.f AND t.fold <> t.f),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, nid) AS rank FROM d) WHERE rank <= 15),
c AS (SELECT f, query_id, y, label, count(*) AS n FROM h GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS rn FROM c),
r AS (SELECT f AS fold, avg((y = label)::INT) AS accuracy, count(*) AS testing_set_size,
             (SELECT count(*) FROM embeddings) - count(*) AS training_set_size FROM p WHERE rn = 1 GROUP BY f)"""


@query("e06_folds", FOLD_SQL + """
SELECT fold, round(accuracy + 1e-9, 6) AS accuracy, testing_set_size, training_set_size FROM r""")
def folds(t: Tables) -> DataFrame:
    found = experiments.run_folds(_plain(t), "vec_id", "v", "label", "grp", 4)
    return found.withColumn("accuracy", r6(F.col("accuracy")))


def _plain(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", doubles(F.col("embedding")).alias("v"), "label", F.expr("vec_id div 10").alias("grp"))


@query("a20_fold_summary", FOLD_SQL + """
SELECT 'cosine-15' AS row_key, round(avg(accuracy) + 1e-9, 6) AS accuracy_mean, round(avg(training_set_size) + 1e-9, 6) AS training_set_size_mean,
       sum(testing_set_size)::BIGINT AS testing_set_size_sum FROM r""")
def fold_summary(t: Tables) -> DataFrame:
    found = experiments.run_folds(_plain(t), "vec_id", "v", "label", "grp", 4).withColumn("row_key", F.lit("cosine-15"))
    summary = evaluation.fold_summary(found, ["row_key"], ["accuracy", "training_set_size"], ["testing_set_size"])
    return summary.withColumns({c: r6(F.col(c)) for c in ("accuracy_mean", "training_set_size_mean")})


@query("e07_configuration", "WITH " + SCALED_SQL + "," + hits_sql("z", 15) + MAJORITY_SQL + """
, x AS (SELECT y, prediction AS y_hat FROM p JOIN (SELECT DISTINCT query_id, y FROM h) USING (query_id) WHERE rn = 1)
SELECT round(avg((y = y_hat)::INT) + 1e-9, 6) AS accuracy, count(*) AS testing_set_size,
       (SELECT count(*) FROM s WHERE train1 = 1)::INT AS training_set_size, 'one' AS row_key FROM x""")
def configuration(t: Tables) -> DataFrame:
    train, test = _sides(t)
    row = experiments.run_configuration(train, test, [0, 1, 2, 3], "one", metric="cosine", k=15, vote="uniform")
    return row.select(r6(F.col("accuracy")).alias("accuracy"), "testing_set_size", "training_set_size", "row_key")


def _grid_configurations() -> list[dict]:
    return [
        {"row_key": f"{m}-{v}-{k}", "metric": m, "vote_type": v, "neighbors": k, "normalize": True}
        for m in grids.EXACT_V3["metric_type"] for v in grids.EXACT_V3["vote_type"] for k in grids.EXACT_V3["neighbors"]
    ]


def _index_configurations() -> list[dict]:
    """Rows with an index: all cells probed, and rows that can't be run."""
    base = {"metric": "cosine", "vote_type": "uniform", "normalize": True, "index": "IVF8,Flat", "nprobe": 8}
    return [
        {**base, "row_key": "ivf-15", "neighbors": 15},
        {**base, "row_key": "ivf-20", "neighbors": 20},
        {**base, "row_key": "bad-cells", "neighbors": 15, "index": "IVF9999999,Flat"},
        {**base, "row_key": "bad-index", "neighbors": 15, "index": "HNSW50,Flat"},
        {**base, "row_key": "bad-vote", "neighbors": 15, "vote_type": "nope"},
        {**base, "row_key": "bad-k", "neighbors": 0},
    ]


GRID_CTES = "WITH " + SCALED_SQL + f"""
, d AS (SELECT m.m, q.vec_id AS query_id, q.label AS y, t.vec_id AS nid, t.label,
        CASE m.m WHEN 'cosine' THEN {METRIC_SQL['cosine']} ELSE {METRIC_SQL['correlation']} END AS distance
        FROM z q, z t, (VALUES ('cosine'), ('correlation')) AS m(m) WHERE q.train1 = 0 AND t.train1 = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY m, query_id ORDER BY distance, nid) AS rank FROM d),
c AS (SELECT m, query_id, y, vote, k, label, round(sum(CASE vote WHEN 'uniform' THEN 1 ELSE 1 / (distance + 1e-6) END), 6) AS w
      FROM h, (VALUES ('uniform'), ('distance')) AS v(vote), (VALUES (15), (20)) AS n(k) WHERE rank <= k GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY m, query_id, vote, k ORDER BY w DESC, label) AS rn FROM c)"""
GRID_SQL = GRID_CTES + """
SELECT concat(m, '-', vote, '-', k) AS row_key, round(avg((y = label)::INT) + 1e-9, 6) AS accuracy, count(*) AS n, 0 AS skipped
FROM p WHERE rn = 1 GROUP BY m, vote, k"""
GRID_INDEX_SQL = GRID_CTES + """
SELECT concat('ivf-', k) AS row_key, round(avg((y = label)::INT) + 1e-9, 6) AS accuracy, count(*) AS n, 0 AS skipped
FROM p WHERE rn = 1 AND m = 'cosine' AND vote = 'uniform' GROUP BY k
UNION ALL SELECT 'bad-' || b, NULL, NULL, 1 FROM (VALUES ('cells'), ('index'), ('vote'), ('k')) AS b(b)"""


def _grid_rows(t: Tables, configurations: list[dict]) -> DataFrame:
    found = experiments.run_grid(*_sides(t), configurations)
    return found.select("row_key", r6(F.col("accuracy")).alias("accuracy"), "n", F.col("skipped").cast("int").alias("skipped"))


@query("e08_shared_grid", GRID_SQL)
def shared_grid(t: Tables) -> DataFrame:
    return _grid_rows(t, _grid_configurations())


@query("e08_index_grid", GRID_INDEX_SQL)
def index_grid_rows(t: Tables) -> DataFrame:
    return _grid_rows(t, _index_configurations())


DATA_GRID_SQL = """
WITH g AS (SELECT DISTINCT label, vec_id // 10 AS grp FROM embeddings),
rk AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42_', grp)), grp) AS rn, count(*) OVER (PARTITION BY label) AS n FROM g),
m AS (SELECT 'holdout' AS split, -1 AS fold, label, grp, rn > (n + 4) // 5 AS train FROM rk
  UNION ALL SELECT 'balanced', -1, label, grp, rn <= (SELECT min(n) FROM rk) * 4 // 5 FROM rk
  UNION ALL SELECT 'folds', f, label, grp, (CASE WHEN rn - 1 < (n % 4) * (n // 4 + 1) THEN (rn - 1) // (n // 4 + 1)
              ELSE n % 4 + (rn - 1 - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END) <> f FROM rk, range(4) AS f(f)),
o AS (SELECT vec_id, label, vec_id // 10 AS grp, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT vec_id, label, grp, 'mean' AS op, list_transform(range(16), lambda i: (v[4 * i + 1] + v[4 * i + 2] + v[4 * i + 3] + v[4 * i + 4]) / 4) AS v FROM o
  UNION ALL SELECT vec_id, label, grp, 'mean_split_2', list_transform(range(32), lambda j: (v[4 * (j % 16) + 2 * (j // 16) + 1] + v[4 * (j % 16) + 2 * (j // 16) + 2]) / 2) FROM o),
r AS (SELECT e.*, split, fold, train FROM e JOIN m ON m.label = e.label AND m.grp = e.grp),
x AS (SELECT op, split, fold, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r WHERE train),
mm AS (SELECT op, split, fold, i, min(x) AS lo, max(x) AS hi FROM x GROUP BY ALL),
ml AS (SELECT op, split, fold, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM mm GROUP BY ALL),
z AS (SELECT r.* EXCLUDE (v), list_transform(v, lambda x, i: (x - lo[i]) / CASE WHEN hi[i] = lo[i] THEN 1 ELSE hi[i] - lo[i] END) AS v FROM r JOIN ml USING (op, split, fold)),
d AS (SELECT q.op, q.split, q.fold, q.vec_id AS query_id, q.label AS y, t.vec_id AS nid, t.label, 1 - list_cosine_similarity(q.v, t.v) AS distance
      FROM z q JOIN z t ON q.op = t.op AND q.split = t.split AND q.fold = t.fold WHERE NOT q.train AND t.train),
h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY op, split, fold, query_id ORDER BY distance, nid) <= 7),
c AS (SELECT op, split, fold, query_id, y, label, count(*) AS n FROM h GROUP BY ALL),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY op, split, fold, query_id ORDER BY n DESC, label) = 1),
a AS (SELECT op, split, fold, avg((y = label)::INT) AS accuracy, count(*) AS n FROM p GROUP BY ALL)
SELECT op || '/' || split AS row_key, nullif(fold, -1)::INT AS fold, round(accuracy + 1e-9, 6) AS accuracy, n AS testing_set_size, (SELECT count(*) FROM embeddings) - n AS training_set_size, false AS skipped FROM a
UNION ALL SELECT k, NULL, NULL, NULL, NULL, true FROM (VALUES ('no feature'), ('no reduction'), ('no index'), ('no literal')) AS t(k)"""


# two reductions, two splits and four folds; every stage that fails skips its own rows
@query("e08_data_grid", DATA_GRID_SQL)
def data_grid(t: Tables) -> DataFrame:
    def load(axes: dict) -> DataFrame:
        if axes["feature"] != "window":
            raise ValueError(f"unknown feature {axes['feature']!r}")
        values = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(doubles(F.col("embedding")), i * 4 + 1, 4))
        return t.embeddings.select(F.col("vec_id").alias("id"), values.alias("matrix"), "label", F.expr("vec_id div 10").alias("grp"))

    base = {"feature": "window", "metric": "cosine", "neighbors": 7, "vote_type": "uniform"}
    grid = [
        {**base, "row_key": f"{operation}/{name}", "operation": operation, "index_params": "{'params': 'Flat', 'neighbors': 7}", **split}
        for operation in ("mean", "mean_split_2")
        for name, split in (("holdout", {}), ("balanced", {"balanced": True}), ("folds", {"folds": 4}))
    ]
    grid += [
        {**base, "row_key": "no feature", "feature": "tempo"},
        {**base, "row_key": "no reduction", "operation": "median"},
        {**base, "row_key": "no index", "index_params": "{'params': 'HNSW32,Flat', 'nprobe': 1}"},
        {**base, "row_key": "no literal", "index_params": "IVF("},
    ]
    found = datagrid.run_data_grid(load, grid)
    return found.select("row_key", "fold", r6(F.col("accuracy")).alias("accuracy"), "testing_set_size", "training_set_size", "skipped")


@query("e09_table_experiment", HITS_SQL + MAJORITY_SQL + """
, x AS (SELECT y, prediction AS y_hat FROM p JOIN (SELECT DISTINCT query_id, y FROM h) USING (query_id) WHERE rn = 1)
SELECT 'vecflow_e09_' || kind AS collection, round(avg((y = y_hat)::INT) + 1e-9, 6) AS accuracy, count(*) AS n
FROM x, (VALUES ('flat'), ('ivf_flat')) AS k(kind) GROUP BY kind""")
def table_experiment(t: Tables) -> DataFrame:
    """One vector table per configuration, filled, indexed and searched by its own index; all cells are probed."""
    train, test = _sides(t)
    results = []
    for kind, params in (("FLAT", {}), ("IVF_FLAT", {"nlist": 8})):
        name = f"vecflow_e09_{kind.lower()}"
        stores.create_collection(
            t.spark, name, "cosine", stores.index_text(kind, params), recreate=True, location=scratch_path(t.spark, name),
            columns="id bigint, vector_data array<double>, label int",
        )
        stores.insert_records(train.withColumnRenamed("vector", "vector_data"), name)
        stores.build_collection_index(t.spark, name)
        hits = stores.search_collection(test, name, 15, nprobe=8)
        predicted = experiments.with_truth(votes.predict(hits, "uniform"), test)
        results.append(evaluation.accuracy(predicted, "y", "y_hat").withColumn("collection", F.lit(name)))
    result = results[0].unionByName(results[1])
    return result.select("collection", r6(F.col("accuracy")).alias("accuracy"), "n")


@query("e11_top_report", """
WITH p AS (SELECT o_orderkey, round(o_totalprice / 10000) AS score, o_orderpriority FROM orders
           ORDER BY score DESC, o_orderpriority, o_orderkey LIMIT 200),
l AS (SELECT *, lag(score, 1, 0) OVER (ORDER BY score DESC, o_orderpriority, o_orderkey) AS previous FROM p)
SELECT o_orderkey, score, o_orderpriority FROM l WHERE score IS DISTINCT FROM previous""")
def top_report(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 10_000).alias("score"), "o_orderpriority", "o_orderdate")
    return reports.distinct_scores_report(rows, 200, "score", ["o_orderpriority", "o_orderkey"], drop=["o_orderdate", "skipped"])


# times and memory differ from run to run: how many of the four are there is compared
@query("e04_grid_rows", _recorded_sql())
def grid_rows(t: Tables) -> DataFrame:
    rows, _ = _recorded(t)
    costs = ("train_elapsed_time", "predict_elapsed_time", "train_used_memory", "predict_used_memory")
    known = sum(((F.col(c) >= 0) & F.col(c).isNotNull()).cast("int") for c in costs)
    numbers = {c: r6(F.col(c)) for c in ("accuracy", *(f"precision_{k}" for k in range(4)))}
    return rows.withColumns({**numbers, "skipped": F.col("skipped").cast("int"), "measured": known}).drop(*costs, "message")


@query("e11_detailed_report", GRID_CTES + """
, r AS (SELECT concat(m, '-', vote, '-', k) AS row_key, y, label FROM p WHERE rn = 1),
a AS (SELECT row_key, avg((y = label)::INT) AS accuracy FROM r GROUP BY row_key),
b AS (SELECT * FROM a ORDER BY accuracy DESC, row_key LIMIT 5),
w AS (SELECT *, lag(accuracy, 1, 0) OVER (ORDER BY accuracy DESC, row_key) AS previous FROM b),
e AS (SELECT row_key, accuracy FROM w WHERE accuracy <> previous),
l AS (SELECT DISTINCT row_key, unnest([y, label]) AS c FROM r SEMI JOIN e USING (row_key)),
x AS (SELECT i.row_key, i.c AS y, j.c AS h, (SELECT count(*) FROM r WHERE r.row_key = i.row_key AND r.y = i.c AND r.label = j.c) AS n
      FROM l i JOIN l j USING (row_key)),
t AS (SELECT row_key, y AS label, string_agg(n::VARCHAR, ',' ORDER BY h) AS counts, max(n) FILTER (y = h) AS hits, sum(n) AS support FROM x GROUP BY ALL),
q AS (SELECT row_key, h AS label, sum(n) AS predicted FROM x GROUP BY ALL),
f AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM t JOIN q USING (row_key, label))
SELECT row_key, round(accuracy + 1e-9, 6) AS accuracy, label, counts, round(pr + 1e-9, 6) AS precision, round(re + 1e-9, 6) AS recall,
       round(coalesce(2 * pr * re / nullif(pr + re, 0), 0) + 1e-9, 6) AS f1, support::BIGINT AS support, 0 AS n_missing FROM f JOIN e USING (row_key)""")
def detailed_report(t: Tables) -> DataFrame:
    """The best rows of the grid with matrix and class report, from predictions kept by row key; a line per class."""
    searches, _ = experiments.run_searches(*_sides(t), _grid_configurations())
    folder = scratch_path(t.spark, "predictions")
    for search in searches:  # as runs come in
        records.keep_predictions(search.pairs, folder)
    pairs = records.kept_predictions(t.spark, folder)
    report = reports.detailed_report(evaluation.pair_results(pairs, ["row_key"], ()), pairs, 5)
    lines = report.select("row_key", "accuracy", "n_missing", F.explode(F.arrays_zip("matrix", "report")).alias("line"))
    numbers = [r6(F.col(f"line.report.{c}")).alias(c) for c in ("precision", "recall", "f1")]
    counts = F.array_join(F.transform("line.matrix.counts", lambda n: n.cast("string")), ",").alias("counts")
    return lines.select("row_key", r6(F.col("accuracy")).alias("accuracy"), F.col("line.report.label").alias("label"), counts, *numbers, F.col("line.report.support").alias("support"), "n_missing")
