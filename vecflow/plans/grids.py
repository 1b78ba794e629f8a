"""Parameter grids as DataFrames, and the text fields of a configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecflow.functions.joins import null_safe_join
from vecflow.functions.vectors import let

# ---- parameter values of the published experiment grids (fixed values) ----

PREPARATION = {
    "segment": [(5, 0), (5, 2), (7, 5), (10, 0), (10, 5)],
    "feature": ["pe-mfcc_20", "pe-mfcc_30", "pe-mfcc_40", "pe-mfcc_50"],
    "vector_operation": ["mean", "mean_iqr15", "mean_iqr25"],
}

EXACT = {
    "segment": [(7, 5), (10, 0), (10, 5)],
    "feature": ["pe-mfcc_40", "pe-mfcc_50"],
    "vector_operation": ["mean", "mean_iqr15", "mean_iqr25"],
    "metric_type": ["cosine", "correlation"],
    "vote_type": ["uniform", "distance"],
    "neighbors": [10, 15, 20],
}

EXACT_V3 = {
    "segment": [(10, "all")],
    "feature": ["pe-mfcc_40"],
    "vector_operation": ["mean", "mean_iqr25"],
    "metric_type": ["cosine", "correlation"],
    "vote_type": ["uniform", "distance"],
    "neighbors": [15, 20],
}

INDEXED = {
    "segment": [(10, "all")],
    "feature": ["pe-mfcc_40"],
    "vector_operation": ["mean", "mean_iqr25"],
    "metric_type": ["cosine", "correlation"],
    "vote_type": ["uniform"],
    "neighbors": [15, 20],
}

STORED = {
    "segment": [(2, 0), (2, 1), (5, 0), (5, 2), (10, 0), (10, 5)],
    "balanced_type": [1, 2],
    "feature": ["mfcc_20", "mfcc_30", "mfcc_40", "mfcc_50"],
    "vector_operation": ["mean", "mean_iqr15", "mean_iqr"],
    "metric_type": ["L2", "COSINE"],
}

FLAT_STORAGE = ["Flat", "SQ8", "SQfp16", "PQ20", "PQ8", "PQ10"]
CELL_PROBES = [
    (1000, 20), (1000, 40), (1000, 100),
    (2000, 40), (2000, 100), (2000, 500),
    (4000, 100), (4000, 250), (4000, 500), (4000, 1000),
]
GRAPH_BUILDS = [(50, 300), (50, 500), (100, 500), (100, 700)]
GRAPH_POOLS = [90, 180, 300]
GRAPH_STORAGE = ["Flat", "SQ8", "PQ10"]

STORED_CELLS = [64, 128, 256]
STORED_PQ = [(64, 1, 8), (64, 10, 8), (128, 1, 16), (128, 10, 16)]
STORED_SQ8 = [(64, 1, 8), (64, 10, 8), (128, 1, 16), (128, 8, 16), (128, 16, 16)]
STORED_GRAPHS = [(16, 200), (32, 200), (64, 200), (16, 400), (32, 400), (64, 400)]

# ---- index parameter texts, built from the values above ----


def flat_params() -> list[str]:
    return [f"{{'params':'{s}'}}" for s in FLAT_STORAGE]


def cell_params() -> list[str]:
    return [f"{{'params':'IVF{n},{s}', 'nprobe': {p}}}" for s in GRAPH_STORAGE for n, p in CELL_PROBES]


def graph_params(pools: Sequence[int] = GRAPH_POOLS) -> list[str]:
    return [
        f"{{'params':'HNSW{m},{s}', 'efConstruction': {c},'efSearch': {e}}}"
        for s in GRAPH_STORAGE for m, c in GRAPH_BUILDS for e in pools
    ]


def graph_params_50() -> list[str]:
    return graph_params([50])


def stored_cell_params() -> list[str]:
    kinds = [("IVF_FLAT", ""), ("IVF_SQ8", ""), ("IVF_PQ", "'m': 8, ")]
    return [
        f"{{'index_type': '{k}', 'params': {{{m}'nlist': {n}}}, 'nprobe': {p}}}" for k, m in kinds for n, p in CELL_PROBES
    ]


def stored_pq_params() -> list[str]:
    return [f"{{'index_type': 'IVF_PQ', 'params': {{'m': 10, 'nlist': {n}}}, 'nprobe': {p}}}" for n, p in CELL_PROBES]


def stored_indexes() -> list[tuple[str, str]]:
    """(index type, parameter text) of the vector-table grid."""
    rows = [("FLAT", "{}")]
    rows += [("IVF_FLAT", f"{{'nlist': {n}}}") for n in STORED_CELLS]
    rows += [("IVF_PQ", f"{{'nlist': {n}, 'm': {m}, 'nbits': {b}}}") for n, m, b in STORED_PQ]
    rows += [("IVF_SQ8", f"{{'nlist': {n}, 'm': {m}, 'nbits': {b}}}") for n, m, b in STORED_SQ8]
    rows += [("HNSW", f"{{'M': {m}, 'efConstruction': {c}}}") for m, c in STORED_GRAPHS]
    return rows


INDEX_LISTS = {
    "flat": flat_params,
    "ivf": cell_params,
    "hnsw": graph_params,
    "hnsw_50": graph_params_50,
    "stored_ivf": stored_cell_params,
    "stored_pq": stored_pq_params,
}

# ---- grids ----


def _literal(value) -> Column:
    if isinstance(value, tuple):
        return F.struct(*[F.lit(str(v)).alias(f"p{i}") for i, v in enumerate(value)])
    return F.lit(value)


def combine(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations of the listed values: one array per parameter, unfolded in turn."""
    grid = spark.range(1).select()
    for name, values in parameters.items():
        if not values:
            raise ValueError(f"no values for {name}")
        grid = grid.select("*", F.explode(F.array(*[_literal(v) for v in values])).alias(name))
    if "segment" in parameters:
        rest = [c for c in grid.columns if c != "segment"]
        grid = grid.select(
            F.col("segment.p0").cast("int").alias("segment_lenght"), F.col("segment.p1").alias("segment_overlap"), *rest
        )
    return grid


def preparation_grid(spark: SparkSession) -> DataFrame:
    return combine(spark, PREPARATION)


def _with_result_columns(grid: DataFrame, measures: Sequence[str]) -> DataFrame:
    empty = {c: F.lit(None).cast("double") for c in measures}
    return grid.withColumns({"skipped": F.lit(False), **empty, "row_key": F.lit(None).cast("string")})


def exact_grid(spark: SparkSession) -> DataFrame:
    return _with_result_columns(combine(spark, EXACT), ["accuracy", "training_set_size", "testing_set_size"])


def exact_grid_v3(spark: SparkSession) -> DataFrame:
    grid = combine(spark, EXACT_V3).withColumn("index_params", F.format_string('{"neighbors":%d}', F.col("neighbors")))
    measures = [
        "accuracy", "precision_0", "precision_1", "precision_2", "precision_3", "training_set_size",
        "testing_set_size", "train_elapsed_time", "predict_elapsed_time", "train_used_memory", "predict_used_memory",
    ]
    return _with_result_columns(grid, measures)


def index_grid(spark: SparkSession, index_params: Sequence[str]) -> DataFrame:
    return combine(spark, {**INDEXED, "index_params": list(index_params)})


def stored_grid(spark: SparkSession) -> DataFrame:
    grid = combine(spark, {**STORED, "index": stored_indexes()})
    return grid.select(
        *[c for c in grid.columns if c != "index"],
        F.col("index.p0").alias("index_type"),
        F.col("index.p1").alias("index_params"),
    )


# ---- configuration texts ----

PARAMS_SCHEMA = "params string, nprobe string, efConstruction string, efSearch string, neighbors string, index_type string"
NESTED_SCHEMA = "nlist string, m string, nbits string"
LITERAL_OPTIONS = {"allowSingleQuotes": "true"}


def literal_fields(text: Column) -> Column:
    """Fields of a parameter literal as one struct; a missing one reads ``None``, except the index name.

    One struct, so that the text is parsed once however many fields are read.
    """
    return let(F.from_json(text, PARAMS_SCHEMA, LITERAL_OPTIONS), lambda p: F.struct(
        p["params"].alias("index_factory"),
        F.coalesce(p["nprobe"], F.lit("None")).alias("nprobe"),
        F.coalesce(p["efConstruction"], F.lit("None")).alias("ef_construction"),
        F.coalesce(p["efSearch"], F.lit("None")).alias("ef_search"),
    ))


def with_literals(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fields of a column of parameter literals; each distinct text is parsed once."""
    parsed = df.select(text).distinct().withColumn(out, literal_fields(F.col(text)))
    return null_safe_join(df, parsed, [text], "left")


def factory_labels(text: Column) -> Column:
    """Index labels that tell configurations apart at three levels of detail, as one struct."""
    return let(literal_fields(text), lambda f: F.struct(
        F.concat_ws("-", f["index_factory"], f["nprobe"]).alias("full_nprobe"),
        F.concat_ws("-", f["index_factory"], f["ef_construction"]).alias("full_build"),
        F.concat_ws("-", f["index_factory"], f["ef_construction"], f["ef_search"]).alias("full_search"),
    ))


def stored_labels(text: Column) -> Column:
    """Index labels of a vector-table configuration in the same notation, IVF<cells>,<storage>, as one struct."""

    def labels(p: Column) -> Column:
        outer, inner = p["outer"], p["inner"]
        nlist, m = F.coalesce(inner["nlist"], F.lit("None")), F.coalesce(inner["m"], F.lit(""))
        kind = outer["index_type"]
        storage = F.when(kind == "IVF_PQ", F.concat(F.lit(",PQ"), m)).otherwise(
            F.replace(F.replace(kind, F.lit("IVF_FLAT"), F.lit(",Flat")), F.lit("IVF_SQ8"), F.lit(",SQ8"))
        )
        return F.struct(
            F.concat(F.lit("IVF"), nlist, storage).alias("index_factory"),
            F.concat_ws("-", kind, nlist, F.coalesce(outer["nprobe"], F.lit("None"))).alias("index_full"),
            m.alias("pq_m"),
        )

    def both(outer: Column) -> Column:
        inner = F.from_json(outer["params"], NESTED_SCHEMA, LITERAL_OPTIONS)
        return F.struct(outer.alias("outer"), inner.alias("inner"))

    return let(let(F.from_json(text, PARAMS_SCHEMA, LITERAL_OPTIONS), both), labels)


def fingerprint(*columns: str) -> Column:
    """MD5 of the JSON text of the columns, in the given order."""
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))


def skip_at_random(key: Column, probability: float, seed: int = 42) -> Column:
    """True for about the given share of keys, the same ones on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % 10_000 < F.lit(int(round(probability * 10_000)))


def feature_parts(name: Column) -> dict[str, Column]:
    """``pe-mfcc_40+stat`` -> base, numeric option and the added statistics."""
    named = F.split(name, "\\+", 2)
    parts = F.split(F.get(named, F.lit(0)), "_", 2)
    return {
        "base": F.get(parts, F.lit(0)),
        "option": F.get(parts, F.lit(1)).try_cast("int"),
        "added": F.coalesce(F.get(named, F.lit(1)), F.lit("")),
    }
