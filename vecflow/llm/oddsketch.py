"""Near-duplicates: banded MinHash, odd sketches of the samples to choose candidates, exact links on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from vecflow.llm.common import WordHashes, column, free_names, kept, map_batches, map_groups, sized, stored, texts
from vecflow.llm.links import components, roots

SAMPLES = 256
BANDS, ROWS = 32, 4  # a pair with similarity 0.8 shares no band with probability 5e-8
SKETCH_BITS = 1024
SLACK = 5.0  # standard errors by which an estimate may fall short
SHARD = 512  # members of a group that meet another SHARD in one task
COLUMNS = 4096

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, SAMPLES, np.uint64)
_PLACES = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = sum(h[i : len(h) - size + 1 + i] * _PLACES[i] for i in range(size))
    return np.unique(mixed(runs))


def samples(items: np.ndarray) -> np.ndarray:
    """MinHash values; long sets go through in pieces."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        out = np.minimum(out, (items[at : at + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x words of 64 bits): each sample flips the bit that its number and value choose."""
    number = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = (mixed(values ^ number) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros((len(values), SKETCH_BITS), np.uint8)
    np.add.at(odd, (np.arange(len(values))[:, None], bit), 1)
    return np.packbits(odd & 1, axis=1).view(np.uint64)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of two lists of sketches: the population count of the XOR, undone for collisions."""
    odd = np.zeros((len(x), len(y)), np.int32)
    for w in range(x.shape[1]):
        odd += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1 / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def least_likeness(similarity: float) -> float:
    """An estimate below this rules a pair out: SLACK standard errors of the samples and of the bitmap's collisions."""
    flips = 2 * SAMPLES * (1 - similarity)
    load = 2 * flips / SKETCH_BITS
    bitmap = np.sqrt(SKETCH_BITS * (np.exp(load) - 1 - load)) / (4 * SAMPLES)
    return similarity - SLACK * float(np.sqrt(similarity * (1 - similarity) / SAMPLES + bitmap**2))


def signatures(df: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Stored (id, n_shingles, set_key, bands, sketch); no key, bands or sketch for an empty set."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, size, hashes) for x in texts(batch, "text")]
            some = np.array([len(s) > 0 for s in sets])
            values = np.array([samples(s) for s in sets if len(s)], np.uint64).reshape(-1, SAMPLES)
            rows = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            bands = mixed(sum(rows[:, :, i] * _PLACES[10 + i] for i in range(ROWS)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            place = iter(range(len(values)))
            sketches = odd_sketches(values)
            at = [next(place) if s else None for s in some]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if i is None else bands[i] for i in at], pa.list_(pa.int64())),
                    pa.array([None if i is None else sketches[i].tobytes() for i in at], pa.binary()),
                ],
                ["id", "n_shingles", "set_key", "bands", "sketch"],
            )

        return work

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return stored(map_batches(rows, make, "id long, n_shingles long, set_key binary, bands array<long>, sketch binary"), "signatures")


def sharded(df: DataFrame, key: str, member: str, members: str) -> DataFrame:
    """Splits each group into shards and deals out every pair of shards (i, j); ``side`` is the row's own shard."""
    count = F.ceil(F.col(members) / SHARD).cast("int")
    own = F.pmod(F.xxhash64(member), count).cast("int")
    dealt = df.withColumns({"side": own, "other": F.explode(F.sequence(F.lit(0), count - 1))})
    return dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", members)


def stars(linked: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    least = roots(linked, nodes)
    far = least != nodes
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], ["a", "b"])


def candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all sets with a chance to be similar: same band, near sizes and near sketches.

    A band's members are compared in blocks of SHARD by SHARD, and a block gives at most one edge per member: a
    spanning forest of its candidate pairs, not the pairs.
    """
    least = least_likeness(similarity)

    def work(table: pa.Table) -> pa.RecordBatch:
        nodes, sizes = table["rep"].to_numpy(), table["n_shingles"].to_numpy()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        near = likeness(sketches, sketches) >= least
        near &= np.minimum(sizes[:, None], sizes) >= similarity * np.maximum(sizes[:, None], sizes) - 1e-9
        return stars(near, nodes)

    banded = reps.select("rep", F.explode("bands").alias("band"))
    sizes = stored(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "bands")
    shared = banded.join(sizes, "band")
    rows = shared.join(reps.select("rep", "n_shingles", "sketch"), "rep")
    return map_groups(sharded(rows, "band", "rep", "members"), ["band", "i", "j"], [], lambda: work, "a long, b long")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Exact links between all pairs of sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    items, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)))
    cuts = np.searchsorted(place, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for a, b, low in zip(cuts[:-1], cuts[1:], range(0, int(shared.sum()), COLUMNS)):
        block = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        block[owner[a:b], place[a:b] - low] = 1
        common += block @ block.T
    union = sizes[:, None] + sizes - common
    return 100 * common >= round(100 * similarity) * union


def links(df: DataFrame, groups: DataFrame, id: str, text: str, size: int, similarity: float) -> DataFrame:
    """Edges (a, b) that join all similar sets within the candidate groups (rep, component, members)."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, size, hashes).tobytes() for x in texts(batch, "text")]
            names = ["rep", "component", "members"]
            return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])

        return work

    def verify(table: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        return stars(similar(sets, similarity), table["rep"].to_numpy())

    rows = df.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("text"))
    rows = rows.join(sized(groups, groups.count()), "rep").select("rep", "component", "members", "text")
    full = map_batches(rows, make, "rep long, component long, members long, set binary").where(F.length("set") > 0)
    return map_groups(sharded(full, "component", "rep", "members"), ["component", "i", "j"], [], lambda: verify, "a long, b long")


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, similarity: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked by shingle sets with at least this similarity.

    Equal sets are one node, the smallest id; the sketches choose groups of nodes that may be linked, and inside them
    every pair is decided on its full sets, so that only pairs without a common band can be missed. A null or empty text
    has an empty set and is its own component. Repeated rows share a component; a row without an id joins its set's
    component, or has none (null) and is kept. No rows give no rows; other columns are not read. Large groups are compared
    block by block, with memory for two blocks; between blocks and groups only spanning edges travel.
    """
    signed = signatures(df, id, text, size)
    found = signed.where("set_key IS NOT NULL")
    first = F.min(F.struct("id", "n_shingles", "bands", "sketch")).alias("r")
    named = found.where("id IS NOT NULL").groupBy("set_key").agg(first)
    reps = stored(named.select("set_key", F.col("r.id").alias("rep"), "r.n_shingles", "r.bands", "r.sketch"), "sets")
    maybe = kept(components(candidates(reps, similarity)))
    sizes = maybe.groupBy("component").agg(F.count("*").alias("members"))
    chosen = kept(maybe.join(sizes, "component").select(F.col("node").alias("rep"), "component", "members"))
    linked = components(links(df, chosen, id, text, size, similarity))
    known = reps.select("set_key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("id", "n_shingles", "set_key").join(known, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def hashable(df: DataFrame, name: str) -> Column:
    """A column in a form that can be hashed: one with maps as its JSON text, with entries in the order of their keys."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, MapType):
        column, kind = F.array_sort(F.map_entries(column)), kind.valueType
    return F.to_json(F.struct(column.alias("v"))) if "map<" in kind.simpleString() else column


def told_apart(df: DataFrame, key: str) -> DataFrame:
    """Adds a 64-bit hash of the whole row that no two different rows share, checked by a second hash and seeded anew if need be."""
    (check,) = free_names(df.withColumn(key, F.lit(0)), 1)
    columns = [f(hashable(df, c)) for c in df.columns for f in (lambda x: x, F.isnull)]
    seed = 0
    while True:
        keyed = df.withColumn(key, F.xxhash64(F.lit(seed), *columns))
        both = keyed.select(key, F.xxhash64(F.lit(-1 - seed), *columns).alias(check))
        if both.groupBy(key).agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a != b").isEmpty():
            return keyed
        seed += 1


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Exactly one row of each group of similar texts, in its own columns: smallest id (null last), then smallest row hash.

    Rows are told apart by a hash of all columns, so rows without an id and rows of a repeated id are judged like all
    others. Of rows without words, those of one id are one row; those without an id all stay. Columns may have any names and
    types; no rows give no rows.
    """
    (key,) = free_names(df, 1)
    keyed = told_apart(df, key)
    own = keyed.select(F.col(key).alias("row"), F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    same = groups(own, "row", "text", size, similarity).groupBy("row").agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("component"))
    rows = own.groupBy("row").agg(F.first("id").alias("id"), F.count("*").alias("copies")).join(same, "row")
    worded = F.col("n") > 0
    rows = rows.where(worded | F.col("id").isNotNull())
    rows = rows.select("row", "id", "copies", F.when(worded, F.col("component")).alias("set"), F.when(~worded, F.col("id")).alias("empty"))
    rows = kept(rows.withColumn("group", F.struct("set", "empty")))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))
    best = rows.groupBy("group").agg(F.min(order)["row"].alias("best"), F.sum("copies").alias("all")).where("all > 1").select("group", "best")
    judged = rows.join(best, "group").select(F.col("row").alias(key), "copies", (F.col("row") == F.col("best")).alias("stays"))
    judged = kept(judged.where("NOT stays OR copies > 1"))
    repeated = judged.where("stays").select(key)
    once = keyed.join(sized(repeated, repeated.count()), key, "left_semi")
    if not repeated.isEmpty():  # equal rows: one of them, by an aggregate, as a column may hold maps
        once = once.groupBy(key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row")).select("row.*")
    alone = keyed.join(sized(judged.select(key), judged.count()), key, "left_anti")
    names = [f"`{c}`" for c in df.columns]
    return alone.select(*names).union(once.select(*names))
