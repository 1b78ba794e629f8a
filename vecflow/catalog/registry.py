"""Name -> query and name -> SQL, and what the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecflow.functions.vectors import doubles
from vecflow.operators import splits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables`; without SQL the query is checked by tests only."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return function

    return add


def r6(value: Column) -> Column:
    """Rounded for comparison; the nudge keeps exact halves on one side in both engines."""
    return F.round(value + F.lit(1e-9), 6)


def cells(df: DataFrame, id: str, vector: str) -> DataFrame:
    """A vector column in long form (id, pos, x)."""
    return df.select(id, F.posexplode(vector).alias("pos", "x")).withColumn("x", r6(F.col("x")))


def embedded(t: Tables, keep: bool = True) -> DataFrame:
    """Vectors with label, recording group and the grouped hold-out flag."""
    rows = t.embeddings.select("vec_id", doubles(F.col("embedding")).alias("v"), "label", F.expr("vec_id div 10").alias("grp"))
    return splits.holdout(rows, "label", "grp", keep=keep)


# the same table in SQL: s(vec_id, label, grp, v, train1)
SPLIT_SQL = """
g AS (SELECT DISTINCT label, vec_id // 10 AS grp FROM embeddings),
rk AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42_', grp)), grp) AS rn,
              count(*) OVER (PARTITION BY label) AS n FROM g),
s AS (SELECT e.vec_id, e.label, rk.grp, e.embedding::DOUBLE[] AS v,
             CASE WHEN rk.rn > (rk.n + 4) // 5 THEN 1 ELSE 0 END AS train1
      FROM embeddings e JOIN rk ON e.label = rk.label AND e.vec_id // 10 = rk.grp)"""

# train-side extremes as lists: ml(lo, hi), and both sides scaled: z(..., v)
SCALED_SQL = SPLIT_SQL + """,
mm AS (SELECT i, min(x) AS lo, max(x) AS hi
       FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s WHERE train1 = 1) GROUP BY i),
ml AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM mm),
z AS (SELECT s.vec_id, s.label, s.grp, s.train1, list_transform(s.v,
             lambda x, i: (x - ml.lo[i]) / CASE WHEN ml.hi[i] = ml.lo[i] THEN 1 ELSE ml.hi[i] - ml.lo[i] END) AS v
      FROM s, ml)"""


def hits_sql(source: str, k: int, distance: str = "1 - list_cosine_similarity(q.v, t.v)") -> str:
    """CTE h(query_id, y, neighbor_id, label, distance, rank) over a flagged vector table."""
    return f"""
d AS (SELECT q.vec_id AS query_id, q.label AS y, q.grp AS grp, t.vec_id AS neighbor_id, t.label AS label,
             t.grp AS hit_grp, {distance} AS distance
      FROM {source} q, {source} t WHERE q.train1 = 0 AND t.train1 = 1),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
      WHERE rank <= {k})"""
