"""Phrase collocations: suffixes of words partitioned by prefix under a memory budget, depth-truncated subtrees, leaf totals.

Three scans of the texts. The first counts words. The second counts pairs of words in hash ranges and leaves one bit per
range slot that holds a frequent pair. The third collects the suffixes of every piece, each cut at four words or where the
next pair is not frequent (no candidate goes on there), deals them by prefix to groups that fit the budget, and reads the
counts of all phrases from the sorted suffixes of each group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.llm.common import map_groups, slices, stored

DEPTH = 4
LEAST = 30  # occurrences of a candidate
COVERED = 80  # percent of its occurrences inside one longer candidate that drop a candidate
TOP = 2_000
CHUNK = 1 << 20  # words of a task that are counted together
BUDGET = 1 << 18  # suffixes of a group
GROUPS = 64  # at least
FILTER_BITS = 16, 30  # log2 of the fewest and most slots of the pair filter
VOCABULARY = 200_000  # different words of a task that are counted together
BREAK = b"\xff"  # no byte of a UTF-8 text
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


class Hashes(dict):
    """64-bit hashes of the words met so far, never 0; 0 stands for the end of a piece."""

    def __init__(self, seed: int):
        self.seed = seed
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > VOCABULARY:
            self.clear()
            self[BREAK] = 0
        self[word] = found = xxhash.xxh64_intdigest(word, self.seed) or 1
        return found


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words with a BREAK after every piece."""
    return ((text or b"").translate(_FOLD).replace(BREAK, b" \xff ") + b" \xff").split()


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in slices(batches):
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """Stored (lang, word, h, f): all words with their hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flushed() -> pa.RecordBatch:
            found = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w != BREAK]
            counts.clear()
            langs, said, numbers = zip(*found) if found else ((), (), ())
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) or 1 for w in said], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(said, pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(numbers, pa.int64())], ["lang", "word", "h", "f"])

        for k, (lang, text) in enumerate(labelled(batches), 1):
            counts[lang].update(words(text))
            if k % 64 == 0 and sum(map(len, counts.values())) > VOCABULARY:
                yield flushed()
        yield flushed()

    parts = rows.mapInArrow(run, "lang string, word string, h long, f long")
    return stored(parts.groupBy("lang", "word", "h").agg(F.sum("f").alias("f")), "phrase-words")


def chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """Hashes of the words of one language, with a 0 after every piece; about CHUNK words or less at a time."""
    hashes, held, size = Hashes(seed), defaultdict(list), 0
    for lang, text in labelled(batches):
        said = words(text)
        held[lang].append(np.fromiter(map(hashes.__getitem__, said), np.uint64, len(said)))
        size += len(said)
        if size >= CHUNK:
            yield from ((k, np.concatenate(v)) for k, v in held.items())
            held, size = defaultdict(list), 0
    yield from ((k, np.concatenate(v)) for k, v in held.items())


def following(x: np.ndarray) -> np.ndarray:
    """The word after each word; 0 at the end of a piece."""
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    out[x == 0] = 0
    return out


def pair_keys(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * SPREAD
    x = ((x ^ (x >> np.uint64(29))) + second) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Filter:
    """Bits of the slots (leading bits of the key) that hold a frequent pair, and the keys of pairs beyond the budget."""

    def __init__(self, log_slots: int, log_buckets: int):
        self.log_slots, self.log_buckets = log_slots, log_buckets
        self.bits = np.zeros((1 << log_slots) // 8, np.uint8)
        self.hot_pairs = self.hot_words = np.zeros(0, np.uint64)
        self.groups = GROUPS

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.log_slots)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def pair_filter(rows: DataFrame, total: int, seed: int, least: int, budget: int) -> Filter:
    """Counts the pairs of neighbouring words by hash ranges; each range leaves its stretch of the filter's bits.

    A pair whose count reaches ``least`` is never missed; merged hashes can only let more suffixes through. The filter has
    eight slots for each pair that could be frequent, and at most 2^30 (128 MB).
    """
    log_slots = min(max(FILTER_BITS[0], int(total * 8 // least).bit_length()), FILTER_BITS[1])
    log_buckets = min(max(6, int(total >> 22).bit_length()), log_slots - 6)
    found = Filter(log_slots, log_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, x in chunks(batches, seed):
            after = following(x)
            keys, counts = np.unique(pair_keys(lang, x, after)[after != 0], return_counts=True)
            bucket = (keys >> np.uint64(64 - log_buckets)).astype(np.int32)
            short = (keys >> np.uint64(32 - log_buckets)).astype(np.uint32)
            some, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:], len(bucket)]
            blobs = [[v[a:b].tobytes() for a, b in zip(starts, ends)] for v in (short, counts.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "keys", "counts"])

    def work(table: pa.Table) -> pa.RecordBatch:
        keys = counts = None
        for k, c in zip(table["keys"], table["counts"]):
            k, c = np.frombuffer(k.as_py(), np.uint32), np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
            keys, counts = (k, c) if keys is None else (np.concatenate([keys, k]), np.concatenate([counts, c]))
            if len(keys) > 1 << 22:
                keys, counts = summed(keys, counts)
        keys, counts = summed(keys, counts)
        often = counts >= least
        slots = np.zeros(1 << (log_slots - log_buckets), np.uint8)
        slots[keys[often] >> np.uint32(32 - (log_slots - log_buckets))] = 1
        bucket = table["bucket"][0].as_py()
        hot = (np.uint64(bucket) << np.uint64(32)) | keys[counts > budget].astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(slots).tobytes()], pa.binary()), pa.array([int(counts[often].sum())], pa.int64()), pa.array([hot.tobytes()], pa.binary())], ["bucket", "bits", "positions", "hot"])

    parts = rows.mapInArrow(count, "bucket int, keys binary, counts binary")
    ranges = map_groups(parts, ["bucket"], [], lambda: work, "bucket int, bits binary, positions long, hot binary").collect()
    size, positions = (1 << (log_slots - log_buckets)) // 8, 0
    for r in ranges:
        found.bits[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        positions += r["positions"]
    found.hot_pairs = np.sort(np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in ranges] or [found.hot_pairs]))
    found.groups = max(GROUPS, -(-positions // budget))
    return found


def within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def suffixes(lang: str, x: np.ndarray, known: Filter) -> pa.RecordBatch:
    """Different suffixes of a chunk with their counts and the group of their prefix.

    A prefix is a word; of a word beyond the budget, its pairs; of a pair beyond it, whole suffixes.
    """
    columns = [x]
    for _ in range(DEPTH - 1):
        columns.append(following(columns[-1]))
    keys = pair_keys(lang, x, columns[1])
    good = (columns[1] != 0) & known.frequent(keys)
    later = good
    for k in range(2, DEPTH):
        later = np.concatenate([later[1:], [False]])
        columns[k] = np.where(later & (columns[k - 1] != 0), columns[k], 0)
    columns, keys = [c[good] for c in columns], keys[good]
    order = np.lexsort(columns[::-1])
    columns, keys = [c[order] for c in columns], keys[order]
    if len(order):
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        starts = np.flatnonzero(new)
        counts = np.diff([*starts, len(order)])
        columns, keys = [c[starts] for c in columns], keys[starts]
    else:
        counts = np.zeros(0, np.int64)
    hot_word = within(columns[0] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())), known.hot_words)
    hot_pair = hot_word & within(keys >> np.uint64(32 - known.log_buckets), known.hot_pairs)
    whole = keys.copy()
    for c in columns[2:]:
        whole = (whole ^ c) * SPREAD
        whole ^= whole >> np.uint64(29)
    by_word = pair_keys(lang, columns[0], np.zeros_like(columns[0]))
    prefix = np.where(hot_pair, whole, np.where(hot_word, keys, by_word))
    depth = np.where(hot_pair, DEPTH, np.where(hot_word, 2, 1)).astype(np.int8)
    group = (prefix % np.uint64(known.groups)).astype(np.int64)
    arrays = [pa.array(group), pa.array([lang] * len(group), pa.string()), *(pa.array(c.view(np.int64)) for c in columns), pa.array(counts.astype(np.int64)), pa.array(depth)]
    return pa.RecordBatch.from_arrays(arrays, ["part", "lang", "w0", "w1", "w2", "w3", "n", "depth"])


def subtree(table: pa.Table, least: int) -> pa.RecordBatch:
    """Nodes of the suffix tree over one group: sorted suffixes are its leaves, a node's count is their total.

    A node shorter than its prefix is spread over groups: such parts are all returned, of the others those with ``least``.
    """
    langs = table["lang"].combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    path = [table[f"w{k}"].to_numpy() for k in range(DEPTH)]
    n, cut = table["n"].to_numpy(), table["depth"].to_numpy()
    order = np.lexsort([cut, *path[::-1], code])
    code, n, cut, path = code[order], n[order], cut[order], [c[order] for c in path]
    out = []
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (path[0][1:] != path[0][:-1])])
    for depth in range(2, DEPTH + 1):
        new = new | np.concatenate([[True], path[depth - 1][1:] != path[depth - 1][:-1]])
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(n, starts)
        there = path[depth - 1][starts] != 0
        keep = there & ((totals >= least) | (np.maximum.reduceat(cut, starts) > depth))
        at = starts[keep]
        nodes = [path[k][at] if k < depth else np.zeros(len(at), np.int64) for k in range(DEPTH)]
        out.append((code[at], *nodes, totals[keep]))
    code, *columns = (np.concatenate(x) for x in zip(*out))
    names = langs.dictionary.take(pa.array(code))
    return pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], ["lang", "w0", "w1", "w2", "w3", "n"])


PATH = ["w0", "w1", "w2", "w3"]


def frequent_phrases(df: DataFrame, lang: str, text: str, least: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, word, h, f) of all words, and (lang, w0..w3, n) of all phrases of 1 to 4 words with ``least`` occurrences."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    context, seed = df.sparkSession.sparkContext, 0
    while True:
        counted = word_counts(rows, seed)
        shared = counted.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a != b")
        if shared.isEmpty():
            break
        seed += 1  # two words share a hash: with other hashes none will
    total = counted.agg(F.sum("f")).first()[0] or 0
    known = pair_filter(rows, total, seed, least, budget)
    hot = counted.where(F.col("f") > budget).select("lang", "h").collect()  # at most total / budget rows
    hot_words = [np.uint64(r["h"] & (1 << 64) - 1) ^ np.uint64(xxhash.xxh64_intdigest(r["lang"].encode())) for r in hot]
    known.hot_words = np.sort(np.array(hot_words, np.uint64))
    shared_filter = context.broadcast(known)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, x in chunks(batches, seed):
            yield suffixes(label, x, shared_filter.value)

    parts = rows.mapInArrow(collect, "part long, lang string, w0 long, w1 long, w2 long, w3 long, n long, depth byte")
    nodes = map_groups(parts, ["part"], [], lambda: lambda t: subtree(t, least), "lang string, w0 long, w1 long, w2 long, w3 long, n long", known.groups)
    longer = nodes.groupBy("lang", *PATH).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    none = F.lit(0).cast("long")
    single = counted.where(F.col("f") >= least).select("lang", F.col("h").alias("w0"), *[none.alias(c) for c in PATH[1:]], F.col("f").alias("n"))
    return counted, stored(longer.union(single), "phrases")


def cut(first: int, length: int) -> list[Column]:
    """The columns of the part of a phrase that starts at ``first`` and has ``length`` words."""
    return [F.col(f"w{first + k}") if k < length else F.lit(0).cast("long") for k in range(DEPTH)]


def part(first: int, length: int, **more: Column) -> Column:
    return F.struct(*[c.alias(f"p{k}") for k, c in enumerate(cut(first, length))], *[c.alias(k) for k, c in more.items()])


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates of 2 to 4 words (lang, w0..w3, m, a, l, r, score) by their lowest-scoring cut; exact, in decimals."""
    m = sum((F.col(c) != 0).cast("int") for c in PATH)
    candidates = phrases.withColumn("m", m).where("m > 1").withColumnRenamed("n", "a")
    cuts = [(k, length) for length in range(2, DEPTH + 1) for k in range(1, length)]
    options = F.array(*[F.when(F.col("m") == length, F.struct(F.lit(k).alias("k"), part(0, k).alias("first"), part(k, length - k).alias("rest"))) for k, length in cuts])
    asked = candidates.withColumn("c", F.explode(F.array_compact(options))).select("lang", *PATH, "m", "a", "c.*")

    def with_count(rows: DataFrame, which: str, out: str) -> DataFrame:
        counts = phrases.select(F.col("lang").alias("lang__"), *[F.col(c).alias(f"{c}__") for c in PATH], F.col("n").alias(out))
        match = F.col("lang") == F.col("lang__")
        for k, c in enumerate(PATH):
            match = match & (F.col(f"{which}.p{k}") == F.col(f"{c}__"))
        return rows.join(counts, match).drop("lang__", *[f"{c}__" for c in PATH], which)

    known = with_count(with_count(asked, "first", "l"), "rest", "r")
    score = F.expr("cast((cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(19,0)) as long)")
    best = known.groupBy("lang", *PATH, "m", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", *PATH, "m", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates that no longer candidate holds in ``covered`` percent or more of their occurrences."""
    inner = [(first, size, length) for length in range(3, DEPTH + 1) for size in range(2, length) for first in range(length - size + 1)]
    parts = F.array(*[F.when(F.col("m") == length, part(first, size)) for first, size, length in inner])
    longer = candidates.where("m > 2").select("lang", "a", F.explode(F.array_compact(parts)).alias("p"))
    most = longer.groupBy("lang", *[F.col(f"p.p{k}").alias(c) for k, c in enumerate(PATH)]).agg(F.max("a").alias("inside"))
    found = candidates.join(most, ["lang", *PATH], "left")
    return found.where(F.col("inside").isNull() | (100 * F.col("inside") < covered * F.col("a"))).drop("inside")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    A null language is ``und``, a null text is empty, repeated rows count again, no rows (and languages without a phrase of
    ``least`` occurrences) give none; other columns are not read. Only counted suffixes are shuffled, equal ones of a chunk
    as one row, and a prefix beyond the budget is split, so a very frequent word or passage is spread over groups. Words are
    64-bit hashes; they are compared with the words of the whole table first and seeded anew if two share one.
    """
    counted, phrases = frequent_phrases(df, lang, text, least, budget)
    best = stored(uncovered(stored(scored(phrases), "phrase-scores"), covered), "phrases-kept")
    order = [F.col("score").desc(), F.col("a").desc()]
    near = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    said = near.select("lang", *PATH, "a", "l", "r", "score", F.posexplode(F.array(*PATH)).alias("at", "h")).where("h != 0")
    said = said.join(counted.select("lang", "h", "word"), ["lang", "h"])
    named = said.groupBy("lang", *PATH, "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = named.withColumn("phrase", F.array_join(F.col("words.word"), " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
