"""Approximate search: compressed vectors and inverted cells.

An index is a DataFrame of stored rows plus a few small parameters (cell centres,
codebooks, per-dimension ranges) whose size does not depend on the number of rows.
Building and searching are Spark jobs; only those parameters come to the driver.
Rows with cells are stored in one folder per cell, and a search reads the folders it asks for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecflow.functions.vectors import dimension, metric_name, prepare, sq8_encode
from vecflow.operators.blocks import ProductCodes, matrix, rough
from vecflow.operators.neighbors import exact_topk, keyed_topk
from vecflow.operators.scaling import fit_minmax
from vecflow.session import scratch_path, shared_dir

DISTANCES_AT_ONCE = 4_000_000
ROUNDS = 8  # of the k-means of codebooks


@dataclass(frozen=True)
class IndexSpec:
    """Storage and search structure read from a text like ``IVF1000,SQ8``."""

    storage: str = "flat"
    cells: int = 0
    parts: int = 0
    bits: int = 8


def parse_spec(text: str) -> IndexSpec:
    *structure, storage = text.split(",")
    spec = IndexSpec()
    for part in structure:
        found = re.fullmatch(r"IVF([1-9]\d*)", part)
        if not found or len(structure) > 1:
            kind = "graph indexes are not built here" if part.startswith("HNSW") else "unknown index"
            raise ValueError(f"{kind}: unknown index {text!r}")
        spec = replace(spec, cells=int(found[1]))
    if storage == "Flat":
        return spec
    if storage == "SQ8":
        return replace(spec, storage="sq8")
    if storage == "SQfp16":
        return replace(spec, storage="fp16")
    found = re.fullmatch(r"PQ(\d+)(?:x(\d+))?", storage)
    if not found:
        raise ValueError(f"unknown index {text!r}")
    bits = int(found[2] or 8)
    if not 1 <= bits <= 24:
        raise ValueError(f"codes have 1 to 24 bits, got {bits}")
    return replace(spec, storage="pq", parts=int(found[1]), bits=bits)


@dataclass
class Index:
    """Stored rows ``(id, vector, label[, cell])``, where vector holds codes unless storage is flat."""

    metric: str
    spec: IndexSpec
    rows: DataFrame
    centres: list = field(default_factory=list)
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    codebooks: list = field(default_factory=list)

    @property
    def angular(self) -> bool:
        return self.metric in ("cosine", "correlation")

    def decoder(self):
        """Numpy function that turns a block of codes into vectors, or the codebooks of product codes; None for plain vectors."""
        if self.spec.storage == "flat":
            return None
        if self.spec.storage == "fp16":
            return lambda codes: codes.astype(np.int16).view(np.float16).astype(np.float64)
        if self.spec.storage == "sq8":
            low, span = np.array(self.low), np.array(self.high) - np.array(self.low)
            return lambda codes: low + np.where(span == 0, 0.0, (codes + 0.5) / 255 * span)
        return ProductCodes([np.array(b) for b in self.codebooks], np.array(self.centres) if self.centres else None)


def fit_centres(df: DataFrame, vector: Column, count: int, n_rows: int, seed: int = 42, iterations: int = 10) -> list:
    """k-means centres of all rows."""
    if count > n_rows:
        raise ValueError(f"{count} centres need at least as many rows, got {n_rows}")
    rows = df.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=count, seed=seed, maxIter=iterations).fit(rows)
    return [c.tolist() for c in model.clusterCenters()]


def append_column(df: DataFrame, vector: str, name: str, kind: str, function: Callable[..., np.ndarray], *also: str) -> DataFrame:
    """Adds (or replaces) an array column computed from blocks of the vector column and of the number columns ``also``."""
    names = [c for c in df.columns if c != name]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema] + [f"`{name}` array<{kind}>"])
    items = {"int": pa.int32(), "smallint": pa.int16(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.ascontiguousarray(function(matrix(batch[vector]), *(batch[c].to_numpy(zero_copy_only=False) for c in also)))
                flat = pa.array(found.ravel(), type=items)
                offsets = pa.array(np.arange(0, found.size + 1, found.shape[1]), type=pa.int32())
                lists = pa.ListArray.from_arrays(offsets, flat)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], lists], names=[*names, name])

    return df.mapInArrow(run, fields)


def with_centres(df: DataFrame, centres: list, count: int, out: str = "probes") -> DataFrame:
    """Adds the numbers of the ``count`` nearest centres of each vector, nearest first."""
    table = np.array(centres)

    def probe(vectors: np.ndarray) -> np.ndarray:
        step = max(1, DISTANCES_AT_ONCE // len(table))
        return np.vstack([nearest(rough(vectors[at : at + step], table, "l2")) for at in range(0, len(vectors), step)]).astype(np.int32)

    def nearest(distances: np.ndarray) -> np.ndarray:
        few = np.sort(np.argpartition(distances, count - 1, axis=1)[:, :count], axis=1)
        order = np.argsort(np.take_along_axis(distances, few, axis=1), axis=1, kind="stable")
        return np.take_along_axis(few, order, axis=1)

    return append_column(df, "vector", out, "int", probe)


def with_cell(df: DataFrame, centres: list) -> DataFrame:
    return with_centres(df, centres, 1).withColumn("cell", F.get("probes", F.lit(0))).drop("probes")


def half_codes(vectors: np.ndarray) -> np.ndarray:
    """Half-precision values, kept as their 16-bit patterns."""
    return vectors.astype(np.float16).view(np.int16)


def code_type(entries: int) -> tuple[str, type]:
    """The smallest signed column and array type for codes below ``entries``."""
    return ("smallint", np.int16) if entries <= 1 << 15 else ("int", np.int32)


def product_coder(codebooks: list) -> Callable[[np.ndarray], np.ndarray]:
    """Per sub-space the number of the nearest codebook entry."""
    books = [np.array(b) for b in codebooks]
    width = books[0].shape[1]

    def encode(vectors: np.ndarray) -> np.ndarray:
        parts = [vectors[:, j * width : (j + 1) * width] for j in range(len(books))]
        codes = [rough(p, b, "l2").argmin(axis=1) for p, b in zip(parts, books)]
        return np.stack(codes, axis=1).astype(code_type(max(map(len, books)))[1])

    return encode


def build_index(
    train: DataFrame,
    spec: IndexSpec | str,
    metric: str = "cosine",
    nbits: int | None = None,
    seed: int = 42,
) -> Index:
    """Trains and fills an index from train rows ``(id, vector, label)``.

    Centres and codebooks are fitted on all rows, which are prepared and stored once for all fits. Product codes in cells are
    of the rest beside the cell's centre. ``nbits`` (default: the text's, else 8) is the size of a code.
    """
    spec = parse_spec(spec) if isinstance(spec, str) else spec
    metric = metric_name(metric)
    rows = train.select("id", prepare(F.col("vector"), metric).alias("vector"), "label")
    index = Index(metric, spec, rows)
    if spec.cells or spec.storage == "pq":
        shared_dir(rows.sparkSession)
        rows = rows.checkpoint()
    n_rows = rows.count()
    if spec.cells:
        index.centres = fit_centres(rows, F.col("vector"), spec.cells, n_rows, seed)
        rows = with_cell(rows, index.centres)
    if spec.storage == "sq8":
        ends = fit_minmax(rows, "vector").first()
        index.low, index.high = list(ends["low"]), list(ends["high"])
        low, high = (F.array(*[F.lit(x) for x in side]) for side in (index.low, index.high))
        rows = rows.withColumn("vector", sq8_encode(F.col("vector"), low, high))
    elif spec.storage == "fp16":
        rows = append_column(rows, "vector", "vector", "smallint", half_codes)
    elif spec.storage == "pq":
        nbits = spec.bits if nbits is None else nbits
        if spec.cells:
            rows = append_column(rows, "vector", "vector", "double", beside(index.centres), "cell").checkpoint()
        index.codebooks = fit_codebooks(rows, spec.parts, nbits, n_rows, seed)
        rows = append_column(rows, "vector", "vector", code_type(2**nbits)[0], product_coder(index.codebooks))
    if spec.cells:
        rows = _by_cell(rows, scratch_path(rows.sparkSession, "cells"))
    elif spec.storage != "flat":
        shared_dir(rows.sparkSession)
        rows = rows.checkpoint()  # encoded once, however often it is searched
    index.rows = rows
    return index


def _by_cell(rows: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Rows stored in one folder per cell; a large cell is written by several tasks."""
    rows.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fit_codebooks(rows: DataFrame, parts: int, nbits: int, n_rows: int, seed: int) -> list:
    """Codebooks of all parts by one k-means loop over all rows: a round reads them once, whatever the number of parts.

    It starts from rows in the order of a hash of their id; an entry that no row is nearest to stays. What comes to the driver
    is one sum per entry.
    """
    dim = dimension(rows, "vector")
    if parts < 1 or dim % parts:
        raise ValueError(f"{parts} parts do not divide dimension {dim}")
    if not 1 <= nbits <= 24:
        raise ValueError(f"codes have 1 to 24 bits, got {nbits}")
    width, entries = dim // parts, 2**nbits
    if entries > n_rows:
        raise ValueError(f"a codebook of {entries} entries needs as many rows, got {n_rows}")
    order = F.xxhash64(F.lit(seed), F.col("id"))
    first = matrix(rows.select("vector", order.alias("o"), "id").orderBy("o", "id").limit(entries).select("vector").toArrow()["vector"])
    books = [first[:, j * width : (j + 1) * width].copy() for j in range(parts)]
    sums = [f"s{d}" for d in range(width)]
    for _ in range(ROUNDS):
        moved = rows.select("vector").mapInArrow(_nearest_sums(books), ", ".join(["part int", "code int", "n bigint", *(f"{c} double" for c in sums)]))
        found = moved.groupBy("part", "code").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)).toPandas()
        for j, rows_of in found.groupby("part"):
            books[j][rows_of["code"].to_numpy()] = rows_of[sums].to_numpy() / rows_of[["n"]].to_numpy()
    return [b.tolist() for b in books]


def _nearest_sums(books: list[np.ndarray]) -> Callable:
    """Per task, part and code the number and the sum of the parts of vectors that are nearest to the code's entry."""
    width, entries = books[0].shape[1], len(books[0])
    encode = product_coder(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((len(books), entries), dtype=np.int64), np.zeros((len(books), entries, width))
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch["vector"])
                for j, code in enumerate(encode(vectors).T):
                    np.add.at(totals[j], code, vectors[:, j * width : (j + 1) * width])
                    counts[j] += np.bincount(code, minlength=entries)
        part, code = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[part, code])]
        names = ["part", "code", "n", *(f"s{d}" for d in range(width))]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(totals[part, code, d]) for d in range(width)], names=names)

    return run


def beside(centres: list) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What is left of vectors once the centre of their cell is taken off."""
    table = np.array(centres)
    return lambda vectors, cells: vectors - table[cells.astype(int)]


def search_index(index: Index, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
    """Top k of every query: ``(query_id, rank, neighbor_id, distance, label)``.

    An inverted search reads the cells that some query asks for; their numbers, at most one per centre, are what comes
    to the driver.
    """
    asked = queries.select("id", prepare(F.col("vector"), index.metric).alias("vector"))
    # angular metrics search prepared vectors by inner product, so codes are not rescaled
    metric = "inner_product" if index.angular else index.metric
    decode = index.decoder()
    if index.centres:
        if nprobe < 1:
            raise ValueError("nprobe must be at least 1")
        probed = min(nprobe, len(index.centres))
        aimed = with_centres(asked, index.centres, probed).withColumn("cell", F.explode("probes")).drop("probes")
        hits = keyed_topk(aimed, _cells(index, aimed, probed), k, metric, decode)
    else:
        hits = exact_topk(asked, index.rows, k, metric, decode=decode)
    return hits.withColumn("distance", F.col("distance") + 1.0) if index.angular else hits


def _cells(index: Index, aimed: DataFrame, probed: int) -> DataFrame:
    """The stored rows of the cells asked for."""
    if probed == len(index.centres):
        return index.rows
    wanted = sorted(r["cell"] for r in aimed.select("cell").distinct().collect())
    return index.rows.where(F.col("cell").isin(wanted))


# ---------------------------------------------------------------- saved indexes


def save_index(index: Index, path: str) -> None:
    """Writes the rows and then, last, the parameters; a folder without parameters is not an index."""
    spark = index.rows.sparkSession
    if index.centres:
        _by_cell(index.rows, f"{path}/rows", "overwrite")
    else:
        index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    spec = index.spec
    parameters = {
        "metric": index.metric, "storage": spec.storage, "cells": spec.cells, "parts": spec.parts, "bits": spec.bits,
        "centres": index.centres, "low": index.low, "high": index.high, "codebooks": index.codebooks,
    }
    spark.createDataFrame([(json.dumps(parameters),)], "value string").write.mode("overwrite").text(f"{path}/parameters")


def load_index(spark: SparkSession, path: str) -> Index:
    p = json.loads(spark.read.text(f"{path}/parameters").first()[0])
    spec = IndexSpec(p["storage"], p["cells"], p["parts"], p["bits"])
    rows = spark.read.parquet(f"{path}/rows")
    return Index(p["metric"], spec, rows, p["centres"], p["low"], p["high"], p["codebooks"])


def cached_index(train: DataFrame, spec: str, metric: str, root: str, key: str, **options) -> Index:
    """Loads the index kept under ``key``, or builds and keeps it.

    The key must name everything the index depends on: data, split, fold, scaler and
    build parameters.
    """
    spark = train.sparkSession
    path = f"{root.rstrip('/')}/key={key}"
    if not path_exists(spark, f"{path}/parameters/_SUCCESS"):
        save_index(build_index(train, spec, metric, **options), path)
    return load_index(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


__all__ = ["Index", "IndexSpec", "build_index", "cached_index", "load_index", "parse_spec", "save_index", "search_index"]
