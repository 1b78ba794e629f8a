"""k-nearest-neighbour joins that never write out all pairs.

Queries and train rows are DataFrames ``(id bigint, vector array<double>[, label])``.
The result is the long form ``(query_id, rank, neighbor_id, distance, label)``;
equal distances are ordered by the smaller neighbour id.

Four plans, chosen by measured size:

* few dimensions, more pairs than can be compared: the space is cut into boxes, and a query only goes
  to the boxes that can hold one of its hits (``boxes``), where that leaves few pairs;
* few queries: they are sent to every executor and each train partition keeps its own
  best k per query - the train table is neither shuffled nor copied;
* many queries, large train table: the train rows stand in cells around pivots, and a query
  only goes to the cells that can hold one of its hits (``pivots``), where that ships fewer rows;
* many queries otherwise: both tables are cut into shards and laid out on a grid of cells. A query
  shard meets every train shard in exactly one cell, every cell holds a bounded number of
  rows, and a cell only emits its best k per query.

All end with one top-k per query over (cells * k) rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.functions.vectors import METRICS, doubles, metric_name
from vecflow.operators import boxes, pivots
from vecflow.operators.blocks import NO_LABEL, ProductCodes, matrix, top_k

BROADCAST_BYTES = 64 * 1024 * 1024
CELL_ROWS = 100_000
CELL_BYTES = 512 * 1024 * 1024
CELL_PAIRS = 4_000_000_000
BLOCK_ROWS = 4096  # train rows of a cell compared at a time
CELLS_PER_CORE = 8
SEED_ROWS = 20_000
SEED_SHARE = 1_000  # a larger table gives one seed in so many rows, so the bound does not weaken as it grows
SEED_FROM = 2_000_000
PIVOT_FROM = 100_000  # train rows from which cells around pivots are tried before the grid
BOX_FROM = 20_000_000_000  # pairs from which boxes are tried in few dimensions
BOX_PAIRS = 200_000_000  # pairs of a task's share of a box

CELL = ["cell", "q_shard", "t_shard"]
Decoder = Callable[[np.ndarray], np.ndarray] | ProductCodes | None

PART_SCHEMA = "query_id bigint, neighbor_id bigint, distance double, label int"
ARROW_PART = pa.schema(
    [("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64()), ("label", pa.int32())]
)


def as_vectors(df: DataFrame, id: str, vector: str, label: str | None = None) -> DataFrame:
    """The (id, vector, label) form used by every search."""
    number = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return df.select(F.col(id).cast("bigint").alias("id"), doubles(F.col(vector)).alias("vector"), number.alias("label"))


def rank_hits(parts: DataFrame, k: int) -> DataFrame:
    """Best k of the partial hits of each query."""
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (
        parts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "neighbor_id", "distance", "label")
    )


def _labels(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _ids(column.cast(pa.int64()).fill_null(NO_LABEL))


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_numpy(), dtype=np.int64) if isinstance(column, pa.ChunkedArray) else np.asarray(
        column.to_numpy(zero_copy_only=False), dtype=np.int64
    )


def _vectors(batch: pa.RecordBatch | pa.Table, decode: Decoder) -> np.ndarray:
    stored = matrix(batch["vector"])
    return decode(stored) if callable(decode) and len(stored) else stored


def _stream(queries: DataFrame, train: DataFrame, k: int, metric: str, skip_same: bool, decode: Decoder) -> DataFrame:
    """Few queries: one pass over the train partitions, the queries come along."""
    table = queries.toArrow()
    bound = np.asarray(table["bound"].to_numpy(), dtype=np.float64) if "bound" in table.column_names else None
    sent = queries.sparkSession.sparkContext.broadcast((_ids(table["id"]), matrix(table["vector"]), bound))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, limits = sent.value
        best = top_k(ids, vectors, k, metric, skip_same, limits, decode)
        for batch in batches:
            if batch.num_rows:
                best.add(_ids(batch["id"]), _vectors(batch, decode), _labels(batch["label"]))
        yield best.batch(ARROW_PART)

    return train.select("id", "vector", "label").mapInArrow(search, PART_SCHEMA)


def _stream_keyed(queries: DataFrame, train: DataFrame, k: int, metric: str, skip_same: bool, decode: Decoder) -> DataFrame:
    """Few queries with cells: each train row is offered to the queries that name its cell."""
    table = queries.select("id", "cell", "vector").toArrow()
    ids, first, row = np.unique(_ids(table["id"]), return_index=True, return_inverse=True)
    cells = _ids(table["cell"])
    asking = {int(c): np.unique(row[cells == c]) for c in np.unique(cells)}
    sent = queries.sparkSession.sparkContext.broadcast((ids, matrix(table["vector"])[first], asking))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, asking = sent.value
        best = top_k(ids, vectors, k, metric, skip_same, None, decode)
        for batch in batches:
            if batch.num_rows:
                near, stored, labels = _ids(batch["id"]), _vectors(batch, decode), _labels(batch["label"])
                held = _ids(batch["cell"])
                for cell in np.unique(held):
                    if int(cell) in asking:
                        rows = held == cell
                        best.add(near[rows], stored[rows], labels[rows], asking[int(cell)], int(cell))
        yield best.batch(ARROW_PART)

    return train.select("id", "cell", "vector", "label").mapInArrow(search, PART_SCHEMA)


def cell_search(
    queries: DataFrame, train: DataFrame, keys: list[str], k: int, metric: str, skip_same: bool = False, decode: Decoder = None
) -> DataFrame:
    """Partial hits of the queries and train rows that share the key columns.

    The caller keeps the rows of a key bounded on both sides.
    """
    has_bound = "bound" in queries.columns
    rows = 4 * BLOCK_ROWS if isinstance(decode, ProductCodes) else BLOCK_ROWS  # codes are short: fewer tables

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.Table.from_batches([], schema=ARROW_PART)
        bound = np.asarray(left["bound"].to_numpy(), dtype=np.float64) if has_bound else None
        best = top_k(_ids(left["id"]), matrix(left["vector"]), k, metric, skip_same, bound, decode)
        cell = right["cell"][0].as_py() if "cell" in keys else None
        for at in range(0, right.num_rows, rows):
            batch = right.slice(at, rows)
            best.add(_ids(batch["id"]), _vectors(batch, decode), _labels(batch["label"]), cell=cell)
        return pa.Table.from_batches([best.batch(ARROW_PART)])

    columns = [*keys, "id", "vector"] + (["bound"] if has_bound else [])
    stored = [*keys, "id", "vector", "label"]
    # toDF gives the sides columns of their own, as both may come from the same table
    return (
        queries.select(*columns)
        .toDF(*columns)
        .groupBy(*keys)
        .cogroup(train.select(*stored).toDF(*stored).groupBy(*keys))
        .applyInArrow(search, PART_SCHEMA)
    )


def streamed_bytes(n_queries: int, dim: int, k: int) -> int:
    """What a task holds when the queries travel: their vectors and k hits (distance, id, label) of each."""
    return n_queries * (dim + 3 * k) * 8


def grid_shape(n_queries: int, n_train: int, cells: int, rows: int = CELL_ROWS) -> tuple[int, int]:
    """(query shards, train shards): cells bounded in rows and pairs, copies kept few.

    A grid of p * g cells ships n_queries * p + n_train * g rows; for a given number of
    cells that is least when the shards are about squares.
    """
    cells = max(cells, math.ceil(n_queries * n_train / CELL_PAIRS), 1)
    query_shards = max(1, round(math.sqrt(cells * n_queries / max(n_train, 1))), math.ceil(n_queries / rows))
    train_shards = max(1, math.ceil(cells / query_shards), math.ceil(n_train / rows))
    return query_shards, train_shards


def cells_wanted(spark) -> int:
    """Cells that keep all cores busy and even out what the hash puts together; each more copies rows and gives k hits per query."""
    return min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), CELLS_PER_CORE * spark.sparkContext.defaultParallelism)


def _shard(id: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(id), shards.cast("bigint"))


def _meet(queries: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds q_shard and t_shard so that each query meets each train row of its cell exactly once.

    Both inputs carry ``cell, q_shards, t_shards``: a query has one own query shard and is
    copied to all train shards of its cell, a train row the other way round.
    """
    left = queries.withColumn("q_shard", _shard(F.col("id"), F.col("q_shards"))).withColumn(
        "t_shard", F.explode(F.sequence(F.lit(0), (F.col("t_shards") - 1).cast("int")))
    )
    right = train.withColumn("t_shard", _shard(F.col("id"), F.col("t_shards"))).withColumn(
        "q_shard", F.explode(F.sequence(F.lit(0), (F.col("q_shards") - 1).cast("int")))
    )
    numbers = {c: F.col(c).cast("int") for c in ("q_shard", "t_shard")}
    return left.withColumns(numbers).drop("q_shards", "t_shards"), right.withColumns(numbers).drop("q_shards", "t_shards")


def _grid(queries, train, k, metric, skip_same, shape: tuple[int, int], decode: Decoder) -> DataFrame:
    layout = {"cell": F.lit(0), "q_shards": F.lit(shape[0]), "t_shards": F.lit(shape[1])}
    left, right = _meet(queries.withColumns(layout), train.withColumns(layout))
    return cell_search(left, right, CELL, k, metric, skip_same, decode)


def _by_pivots(queries, train, k, metric, skip_same, number: int, most_copies: int, rows: int) -> DataFrame | None:
    """Partial hits from the cells around pivots that can hold them; None where the grid ships fewer rows."""
    laid = pivots.lay_out(queries, train, k, metric, skip_same, number, most_copies)
    if laid is None:
        return None
    left, right, counts = laid
    shards = lambda n: F.ceil(F.col(n) / F.lit(rows)).cast("int")
    layout = F.broadcast(counts.select("cell", shards("n_query").alias("q_shards"), shards("n_train").alias("t_shards")))  # a row per pivot
    left, right = _meet(left.join(layout, "cell"), right.join(layout, "cell"))
    return cell_search(left, right, CELL, k, metric, skip_same)


def _by_boxes(queries, train, n_queries: int, n_train: int, k, metric, skip_same, rows: int) -> DataFrame | None:
    """Partial hits from the boxes that can hold them; None where most pairs would have to be compared."""
    laid = boxes.lay_out(queries, train, n_queries, n_train, k + 1 if skip_same else k, metric)
    if laid is None:
        return None
    left, right, counts = laid
    t_shards = F.ceil(F.col("n_train") / F.lit(rows))
    own = F.least(F.col("n_train"), F.lit(rows))
    q_shards = F.ceil(F.greatest(F.col("n_query") / F.lit(rows), F.col("n_query") * own / F.lit(BOX_PAIRS)))
    layout = F.broadcast(counts.select("cell", *(F.greatest(n, F.lit(1)).cast("int").alias(c) for c, n in (("q_shards", q_shards), ("t_shards", t_shards)))))
    left, right = _meet(left.join(layout, "cell"), right.join(layout, "cell"))
    return cell_search(left, right, CELL, k, metric, skip_same)


def keyed_topk(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    metric: str,
    decode: Decoder = None,
    cell_rows: int = CELL_ROWS,
    skip_same: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k nearest train rows of every query among those that share its ``cell``.

    Few queries (measured) travel to the train partitions. Otherwise the sides meet in a
    cogroup on the cell, which can be of any size: a cell with more than ``cell_rows``
    rows on a side is cut into shards, so a hot cell is spread over many tasks. There is
    one layout row per cell.
    """
    metric = metric_name(metric)
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if asked["n"] and streamed_bytes(asked["n"], asked["dim"], k) <= broadcast_bytes:
        return rank_hits(_stream_keyed(queries, train, k, metric, skip_same, decode), k)
    shards = lambda n: F.ceil(F.col(n) / F.lit(cell_rows)).cast("int")
    n_train = train.groupBy("cell").agg(F.count(F.lit(1)).alias("n_train"))
    n_query = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n_query"))
    layout = n_train.join(n_query, "cell").select("cell", shards("n_query").alias("q_shards"), shards("n_train").alias("t_shards"))
    layout = F.broadcast(layout)  # one row per cell
    left, right = _meet(queries.join(layout, "cell"), train.join(layout, "cell"))
    return rank_hits(cell_search(left, right, CELL, k, metric, skip_same, decode), k)


def _sizes(queries: DataFrame, train: DataFrame) -> tuple[int, int, int]:
    """Rows of both sides and the longest query vector, in one job."""
    both = queries.select(F.lit(0).alias("side"), F.size("vector").alias("dim")).unionAll(
        train.select(F.lit(1).alias("side"), F.lit(0).alias("dim"))
    )
    found = {r["side"]: r for r in both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).collect()}
    rows = [found[side]["n"] if side in found else 0 for side in (0, 1)]
    return rows[0], rows[1], found[0]["dim"] if rows[0] else 0


def exact_topk(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    metric: str = "cosine",
    skip_same: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    seed_from: int = SEED_FROM,
    decode: Decoder = None,
    pivot_from: int = PIVOT_FROM,
    *,
    box_from: int = BOX_FROM,
) -> DataFrame:
    """Exact k nearest train rows of every query; ``skip_same`` leaves out the row itself.

    With fewer than k train rows all of them are returned. For a large train table the
    search runs first on a small sample: the k-th distance found there bounds the true
    one from above, so the full pass only emits rows within it - a filter that cannot
    lose a hit, and cuts the rows shuffled into the final top-k. ``decode`` turns stored codes into
    vectors inside the task, or holds the codebooks by which distances of codes are looked up, so that codes and not
    vectors are read and shuffled.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    metric = metric_name(metric)
    n_queries, n_train, dim = _sizes(queries, train)
    if n_queries == 0 or n_train == 0:
        return queries.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, neighbor_id bigint, distance double, label int"
        )
    streams = streamed_bytes(n_queries, dim, k) <= broadcast_bytes
    cells = cells_wanted(queries.sparkSession)
    rows = max(1, min(CELL_ROWS, CELL_BYTES // (8 * max(dim, 1))))
    shape = grid_shape(n_queries, n_train, cells, rows)
    if decode is None and dim <= boxes.MOST_DIM and metric in boxes.METRICS and n_queries * n_train >= box_from:
        parts = _by_boxes(queries, train, n_queries, n_train, k, metric, skip_same, rows)
        if parts is not None:
            return rank_hits(parts, k)
    if not streams and decode is None and n_train >= pivot_from and pivots.usable(metric):
        number = pivots.number_of(n_train, dim, broadcast_bytes or BROADCAST_BYTES)
        parts = _by_pivots(queries, train, k, metric, skip_same, number, n_queries * shape[1] + n_train * shape[0], rows)
        if parts is not None:
            return rank_hits(parts, k)
    if n_train >= seed_from:
        queries = _bounded(queries, train, n_train, k, metric, skip_same, broadcast_bytes, decode)
    if streams:
        parts = _stream(queries, train, k, metric, skip_same, decode)
    else:
        parts = _grid(queries, train, k, metric, skip_same, shape, decode)
    return rank_hits(parts, k)


def _bounded(queries, train, n_train, k, metric, skip_same, broadcast_bytes, decode):
    every = max(1, min(n_train // SEED_ROWS, SEED_SHARE))
    seeds = train.where(F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(every)) == 0)
    found = exact_topk(queries, seeds, k, metric, skip_same, broadcast_bytes, n_train + 1, decode)
    kth = F.col("distance") * F.col("distance") if metric == "euclidean" else F.col("distance")
    limits = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (kth + 1e-9 * F.abs(kth) + 1e-12).alias("bound"))
    return queries.join(limits, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))


def nearest(queries: DataFrame, train: DataFrame, metric: str = "cosine") -> DataFrame:
    """The single nearest train row of every query."""
    return exact_topk(queries, train, 1, metric).drop("rank")


def with_fields(hits: DataFrame, records: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """Hits with the requested fields of the stored records."""
    chosen = records.select(F.col(id).cast("bigint").alias("neighbor_id"), *fields)
    return hits.join(chosen, "neighbor_id", "left")


__all__ = ["METRICS", "as_vectors", "cell_search", "exact_topk", "grid_shape", "keyed_topk", "nearest", "rank_hits", "with_fields"]
