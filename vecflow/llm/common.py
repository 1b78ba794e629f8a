"""What the text operators share: batch maps, grouped streams, scratch tables, measured broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecflow.session import scratch_path, shared_dir

BROADCAST_ROWS = 200_000
SLICE = 512
WORDS_KEPT = 400_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words of digits, letters and non-ASCII


class WordHashes(dict):
    """Hashes of the words met so far; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, so that a task turns only a few texts at a time into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def give_back() -> None:
    """Returns the worker's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work; at its end the worker, which goes on to other tasks and stages, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Slices of Arrow batches through a function that ``make`` prepares once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in slices(batches):
            work = work or make()
            out = work(batch)
            if out is not None:
                yield out

    return df.mapInArrow(trimmed(run), schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(column(batch, k).to_pylist() for k in keys)))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Callable[[pa.Table], pa.RecordBatch | None]], schema: str, partitions: int | None = None) -> DataFrame:
    """A function over each group of bounded size; one shuffle on the keys."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for table in groups(batches, keys):
            work = work or make()
            out = work(table)
            if out is not None and out.num_rows:
                yield out

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def lowered_words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written below the shared folder and read again: lineage ends here, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, **options: str) -> DataFrame:
    """The rows written below the shared folder in buckets of ``key``: a later grouping by it leaves them where they are.

    A task writes a file per bucket that it has rows of, so this is for few large rows. There are as many buckets as a shuffle
    has partitions; the table gets a name of its own in the session's catalogue.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").options(path=path, **options).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def kept(df: DataFrame) -> DataFrame:
    """A small table, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows allow it; a larger side is joined by a shuffle that splits skewed keys."""
    return F.broadcast(df) if rows <= limit else df


def free_names(df: DataFrame, number: int) -> list[str]:
    """Column names that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"new_{k}" for k in range(number + len(taken))) if name not in taken][:number]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uniform(seed: int, *columns: Column) -> Column:
    """A reproducible number in (0, 1) per row, from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double") + 0.5) / float(2**52)
