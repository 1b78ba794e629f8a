"""Near-duplicate vectors: random projections decoded to points of the E8 lattice, neighbouring cells probed, cosines verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.llm.common import column, groups, map_batches, map_groups, sized, slices, stored
from vecflow.llm.links import components

SIMILARITY = 0.95
PROBES = 4  # neighbouring cells besides the own one
MISSES = 1e-3  # share of pairs at the threshold that may share no cell
DENSE = 100_000  # vectors for which the lattice is as wide as the projections' standard deviation
SKETCH_BITS = 256
SLACK = 3.5  # standard errors by which the angle of two sketches may exceed the threshold's
SHARD = 512  # members of a cell or group that meet another SHARD in one block
ROWS = 1 << 15  # rows of whole cells that are compared together


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or all of size 1/2 with an even number of minus signs."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(whole + [list(x) for x in half], float)


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: where the sum is odd, the worst rounded entry goes the other way."""
    z = np.rint(x)
    off = x - z
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    z[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return z


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: even integer points, or those moved by one half, whichever is nearer."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """Per point its lattice point and the ``probes`` neighbours that lie nearest to it (points x cells x 8)."""
    z = decoded(x)
    near = np.argpartition((z - x) @ ROOTS.T, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
    return np.concatenate([z[:, None], z[:, None] + ROOTS[near]], axis=1)


def width(vectors: int) -> float:
    """Standard deviation of a projected coordinate, in lattice units: wider for more vectors, so that a cell holds fewer of them."""
    return max(1.0, (vectors / DENSE) ** (1 / 16))


def tables(scale: float, similarity: float = SIMILARITY, probes: int = PROBES, misses: float = MISSES) -> int:
    """Tables after which a pair at the threshold shares no cell with probability ``misses``; measured on 4,000 random pairs.

    A random projection of two unit vectors only depends on their distance, whatever their dimension.
    """
    rng = np.random.default_rng(5)
    apart = scale * math.sqrt(2 - 2 * similarity)
    x = rng.normal(0, scale, (4_000, 8)) + rng.random((4_000, 8)) * 4
    a, b = cells(x, probes), cells(x + rng.normal(0, apart, x.shape), probes)
    met = (np.abs(a[:, :, None] - b[:, None]).max(axis=3) < 0.25).any(axis=(1, 2)).mean()
    return max(1, math.ceil(math.log(misses) / math.log(1 - met))) if met < 1 else 1


def most_bits(similarity: float) -> float:
    """Sketches that differ in more bits rule a pair out."""
    share = math.acos(similarity) / math.pi
    return SKETCH_BITS * share + SLACK * math.sqrt(SKETCH_BITS * share * (1 - share))


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = column(batch, name)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def keyed(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, key, v): the key of equal vectors; null for a vector that links with nothing."""
    kind = dict(df.dtypes)[vector]
    v = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys: list[bytes | None] = [None] * batch.num_rows
        for rows, m in by_length(batch, "v"):
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            for k, x in zip(rows[good], m[good] + 0.0):
                keys[k] = blake2b(x.tobytes(), digest_size=16).digest()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["id", "key", "v"])

    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v"))
    return map_batches(rows, lambda: work, f"id long, key binary, v {kind if kind in ('array<float>', 'array<double>') else 'array<double>'}")


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def in_cells(nodes: DataFrame, scale: float, number: int) -> DataFrame:
    """Stored (cell, node, sketch): the cells of each vector in ``number`` tables, own and probed alike."""

    def make():
        drawn: dict[int, tuple[np.ndarray, ...]] = {}

        def projections(d: int) -> tuple[np.ndarray, ...]:
            if d not in drawn:
                drawn.clear()
                rng = np.random.default_rng([3, d])
                drawn[d] = rng.normal(0, scale, (d, 8 * number)), rng.random(8 * number) * 4, rng.normal(size=(d, SKETCH_BITS))
            return drawn[d]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            node = column(batch, "node").to_numpy()
            for rows, m in by_length(batch, "v"):
                u, (matrix, shift, planes) = unit(m), projections(m.shape[1])
                sketch = np.packbits(u @ planes >= 0, axis=1)
                x = u @ matrix + shift
                for t in range(number):
                    points = np.rint(2 * cells(x[:, 8 * t : 8 * t + 8], PROBES)).astype(np.int64).view(np.uint64)
                    h = np.full(points.shape[:2], m.shape[1] * 1024 + t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for k in range(8):
                        h = (h ^ points[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
                        h ^= h >> np.uint64(32)
                    of = np.repeat(np.arange(len(rows)), h.shape[1])
                    out.append((h.ravel().view(np.int64), node[rows][of], sketch[of]))
            if not out:
                return None
            cell, node_, sketch = (np.concatenate(x) for x in zip(*out))
            words = sketch.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node_), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))], ["cell", "node", "s0", "s1", "s2", "s3"])

        return work

    return stored(map_batches(nodes.select("node", "v"), make, "cell long, node long, s0 long, s1 long, s2 long, s3 long"), "lattice-cells")


def dealt(df: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """Adds the block (i, j) and the own ``side``: members of a large key (key, members) are split into shards that all meet, pair by pair."""
    rows = df.join(large, key, "left")
    count = F.coalesce(F.ceil(F.col("members") / SHARD), F.lit(1)).cast("int")
    rows = rows.withColumns({"side": F.pmod(F.xxhash64("node"), count).cast("int"), "other": F.explode(F.sequence(F.lit(0), count - 1))})
    return rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "members")


def least_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Per row the smallest row that links (a, b) lead to."""
    label = np.arange(size)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def candidates(spread: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all vectors which share a cell and have near sketches; at most one per member of a cell's block.

    Cells with more than SHARD members are compared shard by shard. A task reads its partition in the order of the cells and
    compares many whole cells at once.
    """
    limit = most_bits(similarity)
    sizes = spread.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    large = stored(sizes.where(F.col("members") > SHARD), "lattice-large")
    rows = dealt(spread, "cell", sized(large, large.count()))
    keys = ["cell", "i", "j"]

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        cell = np.array([table[k].to_numpy() for k in keys])
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        s = np.array([table[f"s{k}"].to_numpy() for k in range(4)]).view(np.uint64)
        bounds = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0), [True]]))
        end = np.repeat(bounds[1:], np.diff(bounds))
        at, found = np.arange(len(node)), []
        step = 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            to = at + step
            apart = np.bitwise_count(s[:, at] ^ s[:, to]).sum(axis=0, dtype=np.int32)
            near = (apart <= limit) & ((cell[1, at] == cell[2, at]) | (side[at] != side[to]))
            found.append((at[near], to[near]))
            step += 1
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found))
        label = least_labels(a, b, len(node))
        far = np.flatnonzero((label != np.arange(len(node))) & (node != node[label]))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in groups(batches, keys):
            if table.num_rows > 1:
                held.append(table)
                size += table.num_rows
            if size >= ROWS:
                out = compare(pa.concat_tables(held))
                held, size = [], 0
                if out is not None:
                    yield out
        if held and (out := compare(pa.concat_tables(held))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, chosen: DataFrame, similarity: float) -> DataFrame:
    """Stored (node, n, least) of each block: rows whose vectors link with the node's, and the smallest node that links lead to.

    Inside a candidate group all pairs are decided on the whole vectors in double precision, block by block.
    """

    def work(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        node, side, copies = (column(batch, c).to_numpy() for c in ("node", "side", "copies"))
        inside = batch.column(batch.schema.get_field_index("i"))[0] == batch.column(batch.schema.get_field_index("j"))[0]
        out = []
        for rows, m in by_length(batch, "v"):
            u = unit(m)
            near = u @ u.T >= similarity
            near &= ~np.eye(len(rows), dtype=bool) if inside else side[rows][:, None] != side[rows]
            a, b = np.nonzero(near)
            order = np.argsort(node[rows], kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            label = order[least_labels(place[a], place[b], len(rows))[place]]
            some = near.any(axis=1)
            out.append((node[rows][some], (near @ copies[rows])[some], node[rows][label][some]))
        found = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["node", "n", "least"])

    groups_ = chosen.groupBy("component").agg(F.count("*").alias("members"))
    rows = nodes.select("node", "v", "copies").join(chosen, "node")
    blocks = dealt(rows, "component", sized(groups_, groups_.count()))
    return stored(map_groups(blocks, ["component", "i", "j"], [], lambda: work, "node long, n long, least long"), "lattice-links")


def linked(df: DataFrame, id: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked by a cosine of at least ``similarity``, one row per row.

    Equal vectors are one node and link with each other. Vectors share a cell of a lattice table, or of its probed
    neighbours, with a probability that ``tables`` sets; near sketches join them to candidate groups, inside which every pair
    is decided on the whole vectors. A null, empty or zero vector, or one with null or non-finite entries, links with nothing;
    vectors of different lengths do not link. Repeated rows are linked copies. A row without an id counts as a link of others;
    its component is that of its vector, null if no member has an id, and it is kept only then. No rows give no rows; other
    columns are not read. Blocks hold at most two shards of a cell or group, and only spanning edges leave them.
    """
    rows = keyed(df, id, vector)
    keys = stored(rows.select("id", "key"), "lattice-keys")
    same = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    scale = width(nodes.count())
    edges = candidates(in_cells(nodes, scale, tables(scale, similarity)), similarity)
    chosen = stored(components(stored(edges.distinct(), "lattice-edges")), "lattice-groups")
    found = links(nodes, chosen, similarity)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    known = nodes.select("node", "key", "first", "copies").join(counts, "node", "left").join(joined, "node", "left")
    known = stored(known.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "lattice-known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    out = keys.join(known.join(least, "component").select("key", "n_links", "component_id"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
