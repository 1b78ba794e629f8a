"""Queries on vector functions, scalers, reductions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecflow.catalog.registry import SPLIT_SQL, Tables, cells, embedded, query, r6
from vecflow.functions import vectors as V
from vecflow.operators import reduction, scaling, splits

# ---------------------------------------------------------------- splits

RANKED_SQL = """
WITH g AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42_', o_custkey)), o_custkey) AS rn,
              count(*) OVER (PARTITION BY o_orderstatus) AS n FROM g)"""


@query("r1_grouped_holdout", RANKED_SQL + """
SELECT o_orderkey, CASE WHEN rn > (n + 4) // 5 THEN 1 ELSE 0 END AS train1 FROM orders JOIN rk USING (o_orderstatus, o_custkey)""")
def grouped_holdout(t: Tables) -> DataFrame:
    return splits.holdout(t.orders, "o_orderstatus", "o_custkey").select("o_orderkey", "train1")


@query("r2_balanced_holdout", RANKED_SQL + """
SELECT o_orderkey, CASE WHEN rn <= (SELECT 4 * min(n) // 5 FROM rk) THEN 1 ELSE 0 END AS train2
FROM orders JOIN rk USING (o_orderstatus, o_custkey)""")
def balanced_holdout(t: Tables) -> DataFrame:
    return splits.balanced_holdout(t.orders, "o_orderstatus", "o_custkey").select("o_orderkey", "train2")


@query("r3_grouped_folds", RANKED_SQL + """
, f AS (SELECT o_orderstatus, o_custkey, CASE WHEN rn - 1 < (n % 4) * (n // 4 + 1) THEN (rn - 1) // (n // 4 + 1)
               ELSE n % 4 + (rn - 1 - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS fold FROM rk)
SELECT o_orderkey, fold::INT AS fold, (fold <> 0)::INT AS train0, (fold <> 1)::INT AS train1, (fold <> 2)::INT AS train2,
       (fold <> 3)::INT AS train3 FROM orders JOIN f USING (o_orderstatus, o_custkey)""")
def grouped_folds(t: Tables) -> DataFrame:
    flagged = splits.kfold_flags(t.orders, "o_orderstatus", "o_custkey", 4)
    return flagged.select("o_orderkey", "fold", "train0", "train1", "train2", "train3")


# ---------------------------------------------------------------- vector functions

VEC_SQL = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def cells_sql(expression: str, source: str = "e") -> str:
    return f"""SELECT vec_id, pos - 1 AS pos, round(x + 1e-9, 6) AS x
FROM (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM (SELECT vec_id, {expression} AS w FROM {source}))"""


@query("v01_unit_vectors", VEC_SQL + cells_sql("list_transform(v, lambda x: 2 * x / sqrt(list_dot_product(v, v) * 4))"))
def unit_vectors(t: Tables) -> DataFrame:
    doubled = _vectors(t).withColumn("v", F.transform("v", lambda x: x * 2))
    return cells(doubled.withColumn("v", V.unit(F.col("v"))), "vec_id", "v")


CENTRED_SQL = VEC_SQL + ", c AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e) "


@query("v02_centred_unit_vectors", CENTRED_SQL + cells_sql("list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))", "c"))
def centred_unit_vectors(t: Tables) -> DataFrame:
    return cells(_vectors(t).withColumn("v", V.centred_unit(F.col("v"))), "vec_id", "v")


# every vector against the mean vector of its label
LABEL_MEANS_SQL = VEC_SQL + """,
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x
      FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label)
SELECT vec_id, round({} + 1e-9, 6) AS distance FROM e JOIN m USING (label)"""


def _to_label_mean(t: Tables, metric: str) -> DataFrame:
    rows = _vectors(t)
    long = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("c"))
    return rows.join(means, "label").select("vec_id", r6(V.distance(F.col("v"), F.col("c"), metric)).alias("distance"))


@query("v03_inner_product", LABEL_MEANS_SQL.format("-list_dot_product(v, c)"))
def inner_product(t: Tables) -> DataFrame:
    return _to_label_mean(t, "inner_product")


@query("v04_squared_l2", LABEL_MEANS_SQL.format("list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i])))"))
def squared_l2(t: Tables) -> DataFrame:
    return _to_label_mean(t, "l2")


@query("v05_cosine", LABEL_MEANS_SQL.format("1 - list_cosine_similarity(v, c)"))
def cosine(t: Tables) -> DataFrame:
    return _to_label_mean(t, "cosine")


@query("v06_correlation", LABEL_MEANS_SQL.format(
    "1 - list_cosine_similarity(list_transform(v, lambda x: x - list_avg(v)), list_transform(c, lambda x: x - list_avg(c)))"))
def correlation(t: Tables) -> DataFrame:
    return _to_label_mean(t, "correlation")


@query("v07_euclidean", LABEL_MEANS_SQL.format("list_distance(v, c)"))
def euclidean(t: Tables) -> DataFrame:
    return _to_label_mean(t, "euclidean")


@query("v08_manhattan", LABEL_MEANS_SQL.format("list_sum(list_transform(v, lambda x, i: abs(x - c[i])))"))
def manhattan(t: Tables) -> DataFrame:
    return _to_label_mean(t, "manhattan")


@query("v09_combined_vectors", VEC_SQL + cells_sql("list_concat(v, list_transform(v, lambda x: -x))"))
def combined_vectors(t: Tables) -> DataFrame:
    v = F.col("v")
    both = V.combine(v, F.transform(v, lambda x: -x))
    return cells(_vectors(t).withColumn("w", both), "vec_id", "w")


@query("v10_vectors_with_stats", VEC_SQL + """
SELECT vec_id, len(v) + 2 AS n, round(list_avg(v) + 1e-9, 6) AS mean,
       round(sqrt(list_avg(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v))))) + 1e-9, 6) AS std FROM e""")
def vectors_with_stats(t: Tables) -> DataFrame:
    extended = _vectors(t).withColumn("w", V.with_stats(F.col("v")))
    return extended.select(
        "vec_id", F.size("w").alias("n"), r6(F.element_at("w", -2)).alias("mean"), r6(F.element_at("w", -1)).alias("std")
    )


@query("v11_scaled_vectors", "WITH " + SPLIT_SQL + """,
p AS (SELECT vec_id, train1, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM p WHERE train1 = 1 GROUP BY i)
SELECT vec_id, i - 1 AS pos, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END + 1e-9, 6) AS x FROM p JOIN m USING (i)""")
def scaled_vectors(t: Tables) -> DataFrame:
    rows = embedded(t)
    scaler = scaling.fit_minmax(rows.where("train1 = 1"), "v")
    return cells(scaling.apply_minmax(rows, scaler, "v"), "vec_id", "v")


# the 64 values read as 8 coefficients x 8 frames
MATRIX_SQL = """
WITH x AS (SELECT vec_id, (i - 1) // 8 AS coeff, (i - 1) % 8 AS frame, v AS x
           FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def _matrices(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", V.frames_of(V.doubles(F.col("embedding")), 8).alias("m"))


@query("v12_minmax_frames", MATRIX_SQL + """
SELECT vec_id, coeff * 8 + frame AS pos, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) + 1e-9, 6) AS x
FROM x WINDOW w AS (PARTITION BY vec_id, frame)""")
def minmax_frames(t: Tables) -> DataFrame:
    flat = F.flatten(reduction.minmax_frames(F.col("m")))
    return cells(_matrices(t).select("vec_id", flat.alias("w")), "vec_id", "w")


@query("v13_standard_frames", MATRIX_SQL + """
SELECT vec_id, coeff * 8 + frame AS pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w + 1e-9, 6) AS x
FROM x WINDOW w AS (PARTITION BY vec_id, frame)""")
def standard_frames(t: Tables) -> DataFrame:
    flat = F.flatten(reduction.standardise_frames(F.col("m")))
    return cells(_matrices(t).select("vec_id", flat.alias("w")), "vec_id", "w")


@query("v14_principal_components")
def principal_components(t: Tables) -> DataFrame:
    rows = _vectors(t)
    reduced = reduction.apply_pca(rows, reduction.fit_pca(rows, "v", 4), "v")
    return cells(reduced, "vec_id", "reduced")


# a full set of components turns the table: traces, squared covariances and lengths stay, so variances are eigenvalues
@query("v14_variances", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
SELECT count(DISTINCT i) AS components, round(sum(c) FILTER (i = j), 6) AS total, round(sum(c * c), 6) AS squares,
       (SELECT round(sum(x * x), 6) FROM x) AS lengths, 0 AS rises FROM c""")
def component_variances(t: Tables) -> DataFrame:
    rows = _vectors(t)
    reduced = reduction.apply_pca(rows, reduction.fit_pca(rows, "v", V.dimension(rows, "v")), "v")
    spread = reduced.select(F.posexplode("reduced").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("var"), F.sum(F.col("x") * F.col("x")).alias("length"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "var"))), lambda c: c["var"])  # one per dimension
    rises = F.size(F.filter(F.sequence(F.lit(1), F.size("variances") - 1), lambda i: F.get("variances", i) > F.get("variances", i - 1) + 1e-9))
    return spread.agg(
        F.count("*").alias("components"), F.round(F.sum("var"), 6).alias("total"), F.round(F.sum(F.col("var") * F.col("var")), 6).alias("squares"),
        F.round(F.sum("length"), 6).alias("lengths"), listed.alias("variances"),
    ).select("components", "total", "squares", "lengths", rises.alias("rises"))


# ---------------------------------------------------------------- scalers


@query("a06_minmax_fit", "WITH " + SPLIT_SQL + """
SELECT i - 1 AS pos, round(min(x) + 1e-9, 6) AS low, round(max(x) + 1e-9, 6) AS high
FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s WHERE train1 = 1) GROUP BY i""")
def minmax_fit(t: Tables) -> DataFrame:
    scaler = scaling.fit_minmax(embedded(t).where("train1 = 1"), "v")
    long = scaler.select(F.posexplode(F.arrays_zip("low", "high")).alias("pos", "e"))
    return long.select("pos", r6(F.col("e.low")).alias("low"), r6(F.col("e.high")).alias("high"))


@query("a07_overall_fit", """
WITH e AS (SELECT list_min(embedding)::DOUBLE AS a, list_max(embedding)::DOUBLE AS b, list_min(embedding)::DOUBLE / 2 AS c,
                  list_max(embedding)::DOUBLE * 3 AS d FROM embeddings),
m AS (SELECT least(min(a), min(c)) AS lo, greatest(max(b), max(d)) AS hi FROM e)
SELECT round(lo - 0.1 * (hi - lo) + 1e-9, 6) AS low, round(hi + 0.1 * (hi - lo) + 1e-9, 6) AS high FROM m""")
def overall_fit(t: Tables) -> DataFrame:
    rows = _vectors(t)
    other = rows.withColumn("v", F.transform("v", lambda x: F.when(x < 0, x / 2).otherwise(x * 3)))
    found = scaling.fit_overall([rows, other], "v", 0.1)
    return found.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


# ---------------------------------------------------------------- reductions


@query("a08_vector_summary", """
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(avg(x) + 1e-9, 6) AS vector_mean, round(stddev_pop(x) + 1e-9, 6) AS vector_std FROM x GROUP BY vec_id""")
def vector_summary(t: Tables) -> DataFrame:
    rows = reduction.add_summary(_vectors(t), "v")
    return rows.select("vec_id", r6(F.col("vector_mean")).alias("vector_mean"), r6(F.col("vector_std")).alias("vector_std"))


def _reduced(t: Tables, operation: str) -> DataFrame:
    rows = _matrices(t).select("vec_id", reduction.reduce_matrix(F.col("m"), operation).alias("w"))
    return cells(rows, "vec_id", "w")


@query("a09_frame_mean", MATRIX_SQL + """
SELECT vec_id, coeff AS pos, round(avg(x) + 1e-9, 6) AS x FROM x GROUP BY vec_id, coeff""")
def frame_mean(t: Tables) -> DataFrame:
    return _reduced(t, "mean")


def iqr_sql(percent: int, blocks: str = "0", per_block: int = 8) -> str:
    p = percent / 100
    return MATRIX_SQL + f""",
b AS (SELECT *, {blocks} AS block FROM x),
q AS (SELECT vec_id, block, coeff, quantile_cont(x, {p}) AS q1, quantile_cont(x, {1 - p}) AS q3 FROM b GROUP BY ALL),
l AS (SELECT vec_id, block, coeff, round(q1 - 1.5 * (q3 - q1), 9) AS lo, round(q3 + 1.5 * (q3 - q1), 9) AS hi FROM q)
SELECT vec_id, block * {per_block} + coeff AS pos, round(avg(x) + 1e-9, 6) AS x
FROM b JOIN l USING (vec_id, block, coeff) WHERE x BETWEEN lo AND hi GROUP BY ALL"""


@query("a10_iqr_mean_10", iqr_sql(10))
def iqr_mean_10(t: Tables) -> DataFrame:
    return _reduced(t, "mean_iqr10")


@query("a10_iqr_mean_15", iqr_sql(15))
def iqr_mean_15(t: Tables) -> DataFrame:
    return _reduced(t, "mean_iqr15")


@query("a10_iqr_mean_25", iqr_sql(25))
def iqr_mean_25(t: Tables) -> DataFrame:
    return _reduced(t, "mean_iqr25")


@query("a10_iqr_mean_by_user", """
WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY user_id),
l AS (SELECT user_id, round(q1 - 1.5 * (q3 - q1), 9) AS lo, round(q3 + 1.5 * (q3 - q1), 9) AS hi FROM q)
SELECT user_id, round(avg(value) + 1e-9, 6) AS iqr_mean, count(*) AS kept
FROM events JOIN l USING (user_id) WHERE value BETWEEN lo AND hi GROUP BY user_id""")
def iqr_mean_by_user(t: Tables) -> DataFrame:
    found = reduction.grouped_iqr_mean(t.events, ["user_id"], "value", 25)
    return found.withColumn("iqr_mean", r6(F.col("iqr_mean")))


@query("a11_split_mean", MATRIX_SQL + """
, b AS (SELECT *, least(frame // 2, 2) AS block FROM x)
SELECT vec_id, block * 8 + coeff AS pos, round(avg(x) + 1e-9, 6) AS x FROM b GROUP BY vec_id, block, coeff""")
def split_mean(t: Tables) -> DataFrame:
    return _reduced(t, "mean_split_3")


@query("a11_iqr_split_mean", iqr_sql(15, "least(frame // 4, 1)"))
def iqr_split_mean(t: Tables) -> DataFrame:
    return _reduced(t, "mean_iqr15_split_2")


def reductions_sql() -> str:
    """All named reductions at once: blocks of the 8 frames, and the outlier bounds of those that filter."""
    ops = ", ".join(f"('{name}', {percent or 'NULL'}, {splits})" for name, (percent, splits) in reduction.REDUCTIONS.items())
    filters = sorted({percent for percent, _ in reduction.REDUCTIONS.values() if percent})
    low, high = (" ".join(f"WHEN {p} THEN quantile_cont(x, {side(p / 100)})" for p in filters) for side in (lambda q: q, lambda q: 1 - q))
    return MATRIX_SQL + f""",
b AS (SELECT operation, percent, vec_id, least(frame // (8 // splits), splits - 1) AS block, coeff, x FROM x, (VALUES {ops}) AS o(operation, percent, splits)),
q AS (SELECT operation, vec_id, block, coeff, CASE percent {low} END AS q1, CASE percent {high} END AS q3 FROM b GROUP BY operation, percent, vec_id, block, coeff),
l AS (SELECT operation, vec_id, block, coeff, round(q1 - 1.5 * (q3 - q1), 9) AS lo, round(q3 + 1.5 * (q3 - q1), 9) AS hi FROM q),
m AS (SELECT operation, vec_id, block, coeff, avg(x) AS x FROM b JOIN l USING (operation, vec_id, block, coeff)
      WHERE lo IS NULL OR x BETWEEN lo AND hi GROUP BY ALL)
SELECT operation, count(*) AS n, round(avg(x) + 1e-9, 6) AS average, round(sum(x * x) + 1e-9, 5) AS squares FROM m GROUP BY operation"""


@query("a12_reductions", reductions_sql())
def reductions(t: Tables) -> DataFrame:
    made = F.array(*[
        F.struct(F.lit(n).alias("operation"), reduction.reduce_matrix(F.col("m"), n).alias("w")) for n in reduction.REDUCTIONS
    ])
    long = _matrices(t).select(F.inline(made)).select("operation", F.explode("w").alias("x"))
    return long.groupBy("operation").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("average"), F.round(F.sum(F.col("x") * F.col("x")) + F.lit(1e-9), 5).alias("squares")
    )


@query("e10_joint_scaling", """
WITH m AS (SELECT least(min(l_discount), min(l_tax)) AS lo, greatest(max(l_discount), max(l_tax)) AS hi,
                  min(l_quantity) AS qlo, max(l_quantity) AS qhi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount - lo) / (hi - lo) + 1e-9, 6) AS l_discount_scaled,
       round((l_tax - lo) / (hi - lo) + 1e-9, 6) AS l_tax_scaled, round((l_quantity - qlo) / (qhi - qlo) + 1e-9, 6) AS l_quantity_scaled
FROM lineitem, m""")
def joint_scaling(t: Tables) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity"]
    times = scaling.scale_jointly(t.lineitem.select(*columns), ["l_discount", "l_tax"])
    both = scaling.scale_jointly(times, ["l_quantity"])
    scaled = ["l_discount_scaled", "l_tax_scaled", "l_quantity_scaled"]
    return both.select(*columns[:4], *[r6(F.col(c)).alias(c) for c in scaled])
