"""Keyed stores: feature tables, caches, vector tables.

A store is a folder of versions. A version is complete once its _SUCCESS marker is
there; readers take the newest complete one, so a lost job never leaves half a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecflow.functions.vectors import dimension, metric_name
from vecflow.operators.indexes import build_index, load_index, parse_spec, path_exists, save_index, search_index
from vecflow.operators.neighbors import as_vectors, exact_topk, with_fields
from vecflow.operators.ranking import latest_by_key
from vecflow.session import scratch_path


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Reads the table kept at ``path``; builds and keeps it first when it is not there."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def parameter_path(root: str, **parameters) -> str:
    """Cache folder named after its parameters."""
    parts = [f"{k}={str(v).replace('/', '_')}" for k, v in sorted(parameters.items())]
    return "/".join([root.rstrip("/"), *parts])


def materialise_all(
    spark: SparkSession, root: str, configurations: Sequence[dict], build: Callable[[dict], DataFrame]
) -> list[str]:
    """Caches one table per configuration; the loop only starts jobs."""
    paths = [parameter_path(root, **c) for c in configurations]
    for path, configuration in zip(paths, configurations):
        materialised(spark, path, lambda c=configuration: build(c))
    return paths


def write_features(df: DataFrame, path: str, feature: str = "feature") -> None:
    """Extracted features, every task writing its own files, in one folder per feature."""
    df.write.mode("overwrite").partitionBy(feature).parquet(path)


def merge_parts(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key over several part tables; the later part wins."""
    if not parts:
        raise ValueError("no parts")
    numbered = [p.withColumn("part_number", F.lit(i)) for i, p in enumerate(parts)]
    merged = reduce(lambda a, b: a.unionByName(b), numbered)
    return latest_by_key(merged, key, F.col("part_number")).drop("part_number")


def write_version(df: DataFrame, root: str) -> str:
    """Writes a new version next to the old ones; it counts once it is complete."""
    versions = _versions(df.sparkSession, root)
    number = 1 + max([_version_number(v)[0] for v in versions], default=0)
    path = f"{root.rstrip('/')}/version={number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_newest(spark: SparkSession, root: str) -> DataFrame | None:
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/{max(versions, key=_version_number)}") if versions else None


def _version_number(name: str) -> tuple[int, str]:
    number, suffix = name.split("=")[1].split("-")
    return int(number), suffix


def _versions(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return [n for n in names if n.startswith("version=") and path_exists(spark, f"{root.rstrip('/')}/{n}/_SUCCESS")]


# ---------------------------------------------------------------- vector tables

# Columns of a vector table; further columns of the records are kept (fixed values).
VECTOR_COLUMNS = (
    "id bigint, vector_data array<double>, queen_status tinyint, queen_presence tinyint, "
    "queen_acceptance tinyint, segment_no tinyint, sub_segment_no tinyint, sub_segment_name string"
)


def collection_name(features: Sequence[str], operation: str, length, overlap) -> str:
    return f"{'_'.join(features)}_vectors_{operation}_len{length}_overlap{overlap}".replace("-", "_")


def create_collection(
    spark: SparkSession, name: str, metric: str, index: str, recreate: bool = False, reset: bool = False,
    extra: str = "", columns: str = VECTOR_COLUMNS, location: str | None = None,
) -> str:
    """Gets a vector table or creates it; ``recreate`` drops it first, ``reset`` empties it.

    Either leaves no old rows behind, also where the table has a location, whose files outlive a drop.
    """
    metric = metric_name(metric)
    if recreate:
        drop_collection(spark, name)
    if not spark.catalog.tableExists(name):
        all_columns = columns + (f", {extra}" if extra else "")
        spark.sql(
            f"CREATE TABLE {name} ({all_columns}) USING parquet "
            + (f"LOCATION '{location}' " if location else "")
            + f"TBLPROPERTIES ('vector.metric' = '{metric}', 'vector.index' = '{index}')"
        )
        if recreate and location:
            clear_collection(spark, name)
    elif reset:
        clear_collection(spark, name)
    return name


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def clear_collection(spark: SparkSession, name: str) -> None:
    _forget_index(spark, name)
    table = spark.table(name)
    spark.createDataFrame([], table.schema).write.insertInto(name, overwrite=True)


def insert_records(df: DataFrame, name: str) -> None:
    """Appends records by column name; columns the records lack become null.

    Missing ids are given above all stored ones; inserts into one table must not run at the same time. The table's index
    no longer holds all rows and has to be built again.
    """
    spark = df.sparkSession
    if "id" not in df.columns:
        last = spark.table(name).agg(F.max("id")).first()[0]
        df = df.withColumn("id", F.monotonically_increasing_id() + F.lit(-1 if last is None else last).cast("bigint") + 1)
    schema = spark.table(name).schema
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"columns not in {name}: {unknown}")
    _forget_index(spark, name)
    present = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    df.select(*[c.alias(f.name) for c, f in zip(present, schema)]).write.insertInto(name)


def count_rows(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()


# The parameters of each kind of index (fixed values).
INDEX_PARAMETERS = {
    "FLAT": (),
    "IVF_FLAT": ("nlist",),
    "IVF_SQ8": ("nlist",),
    "IVF_PQ": ("nlist", "m", "nbits"),
}


def index_text(kind: str, params: dict | None = None) -> str:
    """The index of a vector table, ``IVF_PQ`` with ``{'m': 10, 'nlist': 1000}``, in the notation ``IVF1000,PQ10``.

    Codes of another size than 8 bits are written ``PQ10x12``; a parameter that the kind does not have is an error.
    """
    params = params or {}
    if kind not in INDEX_PARAMETERS:
        raise ValueError(f"unknown index type {kind!r}, expected one of {sorted(INDEX_PARAMETERS)}")
    unknown = sorted(set(params) - set(INDEX_PARAMETERS[kind]))
    if unknown:
        raise ValueError(f"unknown index parameters of {kind}: {unknown}")
    bits = params.get("nbits", 8)
    coded = f"PQ{params.get('m')}" + (f"x{bits}" if bits != 8 else "")
    storage = {"IVF_SQ8": "SQ8", "IVF_PQ": coded}.get(kind, "Flat")
    text = storage if kind == "FLAT" else f"IVF{params.get('nlist')},{storage}"
    parse_spec(text)
    return text


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key LIKE 'vector.%'").collect()
    return {r["key"].removeprefix("vector."): r["value"] for r in rows}


def _forget_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ('vector.built')")


def build_collection_index(spark: SparkSession, name: str, label: str | None = "label", **options) -> None:
    """Builds and keeps the index that the table was created with; a flat table needs none."""
    found = _properties(spark, name)
    if found["index"] == "Flat":
        return
    path = scratch_path(spark, "index")
    save_index(build_index(as_vectors(spark.table(name), "id", "vector_data", label), found["index"], found["metric"], **options), path)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('vector.built' = '{path}')")


def search_collection(
    queries: DataFrame, name: str, k: int, nprobe: int = 1, fields: Sequence[str] = (), label: str | None = "label"
) -> DataFrame:
    """Hits of the queries ``(id, vector)`` in a vector table, by its index and metric, with fields of the records.

    A flat table is searched exactly; a table with an index must have it built since its last insert.
    """
    spark = queries.sparkSession
    found, table = _properties(spark, name), spark.table(name)
    if found["index"] == "Flat":
        hits = exact_topk(queries, as_vectors(table, "id", "vector_data", label), k, found["metric"])
    elif "built" in found:
        hits = search_index(load_index(spark, found["built"]), queries, k, nprobe)
    else:
        raise ValueError(f"the index of {name} is not built")
    return with_fields(hits, table, "id", list(fields)) if fields else hits


def describe_collection(spark: SparkSession, name: str) -> dict[str, str]:
    """Metric and index of a vector table, whether it is built, and the vector length when there are rows."""
    found = _properties(spark, name)
    found["built"] = str(found["index"] == "Flat" or "built" in found).lower()
    table = spark.table(name)
    if not table.isEmpty():
        found["dim"] = str(dimension(table, "vector_data"))
    return found
