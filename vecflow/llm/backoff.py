"""LM scoring: stupid backoff over n-gram counts that are partitioned by hash and joined to each chunk's n-grams."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vecflow.llm.common import WordHashes, column, give_back, map_groups, slices, stored_by, texts

ORDER = 3
ALPHA = 0.4
CHUNK = 1 << 23  # characters of the documents that are scored together
BUCKET_GRAMS = 2_000_000  # entries that meet in one task
ROW = "chunk long, ord int, bucket int, data binary, extra binary"
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def squeezed(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed planes of the bytes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def numbers(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unnumbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["chunk", "ord", "bucket", "data", "extra"])


def chunked(df: DataFrame, id: str, text: str) -> DataFrame:
    """Chunks of neighbouring documents, stored by their number: compressed lower-cased texts; ids, lengths, number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, size = TaskContext.get().partitionId() << 33, [], [], 0

        def closed() -> pa.RecordBatch:
            known = np.array([i is not None for i in ids], "<i8")
            index = np.concatenate([np.array([i or 0 for i in ids], "<i8"), known, np.array([len(x) for x in held], "<i8")])
            words = sum(len(x.split()) for x in held)
            return batch_of([(number, 0, 0, zstandard.compress(b"".join(held), 9), struct.pack("<qq", len(ids), words) + index.tobytes())])

        for batch in slices(batches):
            for i, x in zip(column(batch, "id").to_pylist(), texts(batch, "text")):
                ids.append(i)
                held.append(x.encode("utf-8", "surrogatepass").lower())
                size += len(held[-1])
                if size >= CHUNK:
                    yield closed()
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield closed()

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return stored_by(rows.mapInArrow(run, ROW), "chunks", "chunk", compression="none")


class Grams:
    """The n-grams of a chunk: per order the hash at each place where one ends, as a number in the sorted distinct list."""

    def __init__(self, data: bytes, extra: bytes, order: int, hashes: WordHashes):
        n, _ = struct.unpack_from("<qq", extra)
        index = np.frombuffer(extra, "<i8", offset=16)
        self.ids = [int(i) if k else None for i, k in zip(index[:n], index[n : 2 * n])]
        whole, found, at = zstandard.decompress(data), [], 0
        for size in index[2 * n :].tolist():
            found.append(whole[at : at + size].split())
            at += size
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.owner = np.repeat(np.arange(n), self.sizes)
        words = np.fromiter((hashes[w] for x in found for w in x), np.uint64, int(self.sizes.sum()))
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.ends, self.number, self.distinct, self.counts = [], [], [], []
        for k in range(1, order + 1):
            ends = np.flatnonzero(place >= k - 1)
            mixed = np.full(len(ends), k, np.uint64)
            for back in range(k):
                mixed = (mixed ^ words[ends - back]) * np.uint64(_ODD[back % len(_ODD)])
                mixed ^= mixed >> np.uint64(29)
            distinct, number, counts = np.unique(mixed * np.uint64(_ODD[-1]), return_inverse=True, return_counts=True)
            self.ends.append(ends)
            self.number.append(number)
            self.distinct.append(distinct)
            self.counts.append(counts)


def asked(grams: Grams, chunk: int, buckets: int) -> pa.RecordBatch | None:
    """A row per order and bucket: the chunk's distinct n-grams there and how often it has them."""
    rows = []
    for k, (distinct, counts) in enumerate(zip(grams.distinct, grams.counts), 1):
        cuts = np.searchsorted(distinct, bounds(buckets))
        for b, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(distinct)])):
            if high > low:
                rows.append((chunk, k, b, squeezed(distinct[low:high]), numbers(counts[low:high])))
    return batch_of(rows) if rows else None


def bounds(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def answered(table: pa.Table) -> pa.RecordBatch:
    """The counts of one bucket over all chunks, joined to the n-grams that each chunk asked for."""
    lists = [unsqueezed(x) for x in table["data"].to_pylist()]
    counts = np.concatenate([unnumbers(x) for x in table["extra"].to_pylist()])
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(int(place.max()) + 1, np.int64)
    np.add.at(total, place, counts)
    found, rows, at = total[place], [], 0
    keys = zip(table["chunk"].to_pylist(), table["ord"].to_pylist(), table["bucket"].to_pylist(), lists)
    for chunk, order, bucket, distinct in keys:
        rows.append((chunk, order, bucket, numbers(found[at : at + len(distinct)]), None))
        at += len(distinct)
    return batch_of(rows)


def scored(grams: Grams, totals: list[np.ndarray], everything: int, order: int, alpha: float, leave_out: bool) -> pa.RecordBatch:
    """Per document the sum of its words' log scores, and how many words were scored at each order."""
    n, length = len(grams.ids), len(grams.owner)
    counts = []
    for k in range(order):
        ends, number = grams.ends[k], grams.number[k]
        found = totals[k][number]
        if leave_out:
            pair = grams.owner[ends] * np.int64(max(1, len(grams.distinct[k]))) + number
            _, place, own = np.unique(pair, return_inverse=True, return_counts=True)
            found = found - own[place]
        full = np.zeros(length, np.int64)
        full[ends] = found
        counts.append(full)
    rest = everything - (grams.sizes[grams.owner] if leave_out else 0)
    level = np.zeros(length, np.int64)
    for k in range(order):
        good = counts[k] > 0
        if k:  # an n-gram that was seen has seen its context; if equal hashes say otherwise, the word backs off
            good[1:] &= counts[k - 1][:-1] > 0
        level[good] = k + 1
    odds = np.log(alpha / np.maximum(rest, 1))
    longest = np.zeros(length, np.int64)
    for k in range(order):
        longest[grams.ends[k]] = k + 1
        here = np.flatnonzero(level == k + 1)
        under = counts[k - 1][here - 1] if k else np.broadcast_to(rest, length)[here]
        odds[here] = np.log(counts[k][here] / under)
    odds = odds + math.log(alpha) * np.where(level > 0, longest - level, np.maximum(longest - 1, 0))
    sums = np.bincount(grams.owner, odds, n) if length else np.zeros(n)
    hits = [np.bincount(grams.owner[level == k], minlength=n) for k in range(order + 1)]
    mean = [s / w if w else None for s, w in zip(sums.tolist(), grams.sizes.tolist())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(grams.ids, pa.int64()),
            pa.array(grams.sizes),
            pa.array(sums),
            pa.array(mean, pa.float64()),
            pa.array(np.stack(hits, axis=1).astype(np.int64).tolist(), pa.list_(pa.int64())),
        ],
        ["id", "n_words", "log_score", "mean_log_score", "seen"],
    )


def scores(df: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, seen) of each document under the n-gram counts of all others.

    Words are runs of other characters than blanks, tabs and line ends, A-Z lower-cased. A word's score is the count of the
    longest n-gram up to ``order`` that ends with it and was seen, over its context's count, times ``alpha`` for each shorter
    step; a single word is counted against all words, a word never seen counts ``alpha`` times. ``leave_out`` takes the
    document's own counts out, so that a text is not explained by itself. ``seen[k]`` counts the words scored by k-grams.

    A null or empty text has no words: score 0, mean null. Repeated rows are documents of their own; rows without an id are
    scored; no rows give no rows; other columns are not read. Documents are scored in chunks: a chunk sends each distinct
    n-gram once to the bucket of its hash of 64 bits and gets the corpus count back, so no word or n-gram is hot. The number
    of buckets follows the number of words. Only n-grams and counts are shuffled: the counts come to where the chunk is stored.
    """
    chunks = chunked(df, id, text)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [struct.unpack_from("<qq", x)[1] for x in column(batch, "extra").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], ["words"])

    sizes = chunks.select("extra").mapInArrow(lambda batches: (counted(b) for b in batches if b.num_rows), "words long")
    everything = int(sizes.agg(F.sum("words")).first()[0] or 0)
    buckets = max(1, everything // BUCKET_GRAMS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, data, extra in zip(*(column(batch, c).to_pylist() for c in ("chunk", "data", "extra"))):
                out = asked(Grams(data, extra, order, hashes), chunk, buckets)
                if out is not None:
                    yield out

    hashes = WordHashes()  # one per task

    def score(held: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for data, extra in zip(held["data"].to_pylist(), held["extra"].to_pylist()):  # one
            grams = Grams(data, extra, order, hashes)
            totals = [np.zeros(0, np.int64)] * order
            if found.num_rows:
                found = found.sort_by([("ord", "ascending"), ("bucket", "ascending")])
                level = found["ord"].to_pylist()
                totals = [np.concatenate([unnumbers(d.as_py()) for d, o in zip(found["data"], level) if o == k] or totals[:1]) for k in range(1, order + 1)]
            rows.append(scored(grams, totals, everything, order, alpha, leave_out))
        give_back()
        return pa.Table.from_batches(rows)

    answers = map_groups(chunks.mapInArrow(ask, ROW), ["ord", "bucket"], [], lambda: answered, ROW, order * buckets)
    both = chunks.select("chunk", "data", "extra").groupBy("chunk").cogroup(answers.select("chunk", "ord", "bucket", "data").groupBy("chunk"))
    found = both.applyInArrow(score, "id long, n_words long, log_score double, mean_log_score double, seen array<long>")
    return found.withColumnRenamed("id", id)


def report(df: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """Scores with a column per order."""
    order = options.get("order", ORDER)
    found = scores(df, id=id, **options)
    return found.select(id, "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), *(F.get("seen", F.lit(k)).alias(f"seen_{k}") for k in range(order + 1)))
