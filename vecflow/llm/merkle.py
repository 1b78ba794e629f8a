"""Merkle manifest of a table: aligned builders append their nodes to postorder logs, closed-form positions find the siblings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.llm.common import column, map_batches, map_groups, stored
from vecflow.llm.mixing import numbered

FAN = 3
DEPTH = 6  # levels that one builder writes
BLOCK = FAN**DEPTH  # leaves of one builder
WIDTH = 32  # bytes of a digest
PLACE = (1 << 33) - 1


def joined(nodes: Sequence[bytes]) -> bytes:
    """The parent of a run of nodes: SHA-256 of their hexadecimal texts in order."""
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while FAN**levels < leaves:
        levels += 1
    return levels


def append_log(leaves: Sequence[bytes], levels: int) -> list[bytes]:
    """All nodes of the tree over ``leaves``, ``levels`` high, in the order in which they are complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def add(node: bytes, level: int) -> None:
        log.append(node)
        open_[level].append(node)
        if level < levels and len(open_[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        add(joined(run), level + 1)

    for leaf in leaves:
        add(leaf, 0)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def position(leaf: int, level: int, leaves: int, levels: int) -> int:
    """Place in the log of the node of ``level`` above ``leaf``.

    It is complete with its last leaf e: before e stand e leaves and e // 3^m nodes of each level m, since that many whole
    subtrees are complete; after e, one node per level up to this one.
    """
    last = min((leaf // FAN**level + 1) * FAN**level, leaves) - 1
    return last + sum(last // FAN**m for m in range(1, levels + 1)) + level


def siblings(leaf: int, leaves: int, levels: int) -> list[tuple[int, list[int]]]:
    """Per level from the leaf up: the own place in the run, and where the run's other nodes stand in the log."""
    out = []
    for level in range(levels):
        own, width = leaf // FAN**level, FAN**level
        run = range(own - own % FAN, own - own % FAN + FAN)
        out.append((own % FAN, [position(c * width, level, leaves, levels) for c in run if c != own and c * width < leaves]))
    return out


def packed(leaf: int, leaves: int, levels: int, log: bytes) -> bytes:
    """A proof path: per level the own place, the number of siblings and their digests."""
    steps = siblings(leaf, leaves, levels)
    return b"".join(bytes([place, len(at)]) + b"".join(log[WIDTH * p : WIDTH * (p + 1)] for p in at) for place, at in steps)


def steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        place, number = path[at], path[at + 1]
        at += 2
        out.append((place, [path[at + WIDTH * k : at + WIDTH * (k + 1)] for k in range(number)]))
        at += WIDTH * number
    return out


def folded(node: bytes, path: Sequence[tuple[int, list[bytes]]]) -> bytes:
    """The root that follows from a node and its proof path."""
    for place, others in path:
        node = joined([*others[:place], node, *others[place:]])
    return node


def proof_text(path: Sequence[tuple[int, list[bytes]]]) -> str:
    return "".join(x.hex() for _, others in path for x in others)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values' texts, each with its length in bytes before it; ``-`` for null."""
    said = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def tree_key(value: Column) -> Column:
    """A text in the order of the values' UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def ranked(leaves: DataFrame) -> DataFrame:
    """Adds the place ``i`` of each leaf in its tree and the tree's size ``n``.

    A range sort of (tree, id, digest); only one row per tree and sorted partition is gathered, so a tree may span any
    number of partitions.
    """
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest")]
    rows = stored(leaves.sort(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit(PLACE))})
    runs = rows.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("size").over(Window.partitionBy("tree"))
    starts = stored(runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), total.alias("n")), "merkle-runs")
    found = rows.join(starts, ["tree", "part"])
    return found.select("tree", (F.col("at") + F.col("shift")).alias("i"), "n", "digest", "id", "witness")


def built(nodes: DataFrame) -> DataFrame:
    """One row per aligned block of BLOCK nodes: its log, and what its leaves carry."""

    def work(table: pa.Table) -> pa.RecordBatch:
        leaves, n = table["digest"].to_pylist(), table["n"][0].as_py()
        log = append_log(leaves, min(DEPTH, height(n)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([table["tree"][0].as_py()]),
                pa.array([table["block"][0].as_py()], pa.int64()),
                pa.array([n], pa.int64()),
                pa.array([len(leaves)], pa.int64()),
                pa.array([b"".join(log)], pa.binary()),
                pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([table["witness"].to_pylist()], pa.list_(pa.binary())),
            ],
            ["tree", "block", "n", "leaves", "log", "ids", "witnesses"],
        )

    rows = nodes.withColumn("block", F.floor(F.col("i") / BLOCK))
    schema = "tree string, block long, n long, leaves long, log binary, ids array<long>, witnesses array<binary>"
    return map_groups(rows, ["tree", "block"], ["i"], lambda: work, schema)


def forest(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of stored blocks of all trees, and (tree, digest) of their tops.

    The last nodes of a tier's blocks are the leaves of the next tier, each 3^6 times smaller.
    """
    tiers = []
    while True:
        tiers.append(stored(built(nodes), name))
        top = F.expr(f"substring(log, -{WIDTH}, {WIDTH})").alias("digest")
        more = tiers[-1].where(F.col("n") > BLOCK)
        if more.isEmpty():
            break
        nothing = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("witness")]
        nodes = more.select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), top, *nothing)
    tops = [t.where(F.col("n") <= BLOCK).select("tree", top) for t in tiers]
    return tiers, stored(union(tops), f"{name}-tops")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def descended(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, block, path, subroot, root) for every leaf of a tier's blocks; a leaf is a block of the tier below."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for r in batch.to_pylist():
                levels = min(DEPTH, height(r["n"]))
                for k in range(r["leaves"]):
                    own = packed(k, r["leaves"], levels, r["log"])
                    out.append((r["tree"], r["block"] * BLOCK + k, own + r["path"], r["subroot"], r["root"]))
            types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)], ["tree", "block", "path", "subroot", "root"])

        return work

    rows = tier.select("tree", "block", "n", "leaves", "log").join(paths, ["tree", "block"])
    return map_batches(rows, make, "tree string, block long, path binary, subroot binary, root binary")


@dataclass
class Manifest:
    """Logs of all trees and of the tree over their tops, as stored tables of blocks."""

    tiers: list[DataFrame]
    subroots: DataFrame  # tree, digest, position
    root_tiers: list[DataFrame]
    root: DataFrame  # tree, digest: one row, none for an empty table

    def paths(self) -> DataFrame:
        """(tree, block, path, subroot, root) of every block of leaves: the proof path of the block's top."""
        nothing = F.lit(b"")
        whole = self.root.select("tree", F.lit(0).cast("long").alias("block"), nothing.alias("path"), nothing.alias("subroot"), F.col("digest").alias("root"))
        for tier in reversed(self.root_tiers):
            whole = stored(descended(tier, whole), "merkle-paths")
        tops = whole.select(F.col("block").alias("position"), "path", "root").join(self.subroots, "position")
        tops = stored(tops.select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"), "merkle-paths")
        paths = None
        for tier in reversed(self.tiers):
            ending = tops.join(tier.where(F.col("n") <= BLOCK).select("tree"), "tree")
            paths = ending if paths is None else ending.union(paths)
            if tier is not self.tiers[0]:
                paths = stored(descended(tier, paths), "merkle-paths")
        return paths

    def proofs(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, path (all siblings up to the root) and witness."""
        return self._per_leaf(lambda r, k, digest, path, upper: (path + upper,), "path binary", [pa.binary()])

    def checked(self) -> DataFrame:
        """Per leaf the digest of its siblings and the root that its witness (else the leaf) leads to with them."""

        def row(r, k, digest, path, upper):
            own, rest = steps(path), r["above"]
            end = folded(folded(r["witnesses"][k] or digest, own), rest[0])
            return sha256((proof_text(own) + rest[1]).encode()).digest(), end, end == r["root"]

        return self._per_leaf(row, "proof binary, folded_root binary, verified boolean", [pa.binary(), pa.binary(), pa.bool_()])

    def _per_leaf(self, of, more: str, more_types: list) -> DataFrame:
        names = ["id", "leaf", "subroot", "root", "witness", *(x.split(" ")[0] for x in more.split(", "))]
        types = [pa.int64(), *[pa.binary()] * 4, *more_types]

        def make():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for r in batch.to_pylist():
                    levels, upper = min(DEPTH, height(r["n"])), steps(r["path"])
                    r["above"] = (upper, proof_text(upper))
                    for k, id_ in enumerate(r["ids"]):
                        at = position(k, 0, r["leaves"], levels)
                        leaf = r["log"][WIDTH * at : WIDTH * (at + 1)]
                        own = packed(k, r["leaves"], levels, r["log"])
                        out.append((id_, leaf, r["subroot"], r["root"], r["witnesses"][k], *of(r, k, leaf, own, r["path"])))
                return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names)

            return lambda batch: work(batch) if batch.num_rows else None

        rows = self.tiers[0].join(self.paths(), ["tree", "block"])
        return small_batches(rows, make, f"id long, leaf binary, subroot binary, root binary, witness binary, {more}")


def small_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """As ``map_batches``, a block at a time: a row holds a whole block."""

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(batch.num_rows):
                out = work(batch.slice(at, 1))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def manifest(df: DataFrame, tree: str = "source", id: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), witness: Sequence[Column] | None = None) -> Manifest:
    """The manifest of a table: a tree of threes per value of ``tree``, and a tree over the trees' tops.

    A leaf is the digest of ``columns``; leaves stand by id (null first; equal ids by digest, so repeated rows are
    neighbours and each has its own proof). ``witness`` gives the columns of other versions of the rows, whose digests
    travel with the leaves to ``checked``. A null tree is a tree of its own, before all others. No rows give no root and no
    proofs. Columns that are not named are not read. Texts stay where they are read; per row about a hundred bytes are
    sorted, then dealt by blocks of 3^6 leaves. A block is built in one task, so that a tree of any size is spread.
    """
    named = [F.col(f"`{c}`") for c in columns]
    digest = leaf_digest(named)
    other = F.lit(None).cast("binary") if witness is None else F.nullif(leaf_digest(witness), digest)
    leaves = df.select(tree_key(F.col(f"`{tree}`")).alias("tree"), F.col(f"`{id}`").cast("long").alias("id"), digest.alias("digest"), other.alias("witness"))
    tiers, tops = forest(ranked(stored(leaves, "merkle-leaves")), "merkle-log")
    subroots = stored(numbered(tops, "tree"), "merkle-subroots")
    number = subroots.count()
    nodes = subroots.select(F.lit("").alias("tree"), F.col("position").alias("i"), F.lit(number).cast("long").alias("n"), "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("witness"))
    root_tiers, root = forest(nodes, "merkle-root-log")
    return Manifest(tiers, subroots, root_tiers, root)


def tampered(df: DataFrame, id: str = "doc_id", text: str = "text") -> list[Column]:
    """The documents' columns, with the line feeds of every text gone where 2 divides the CRC-32 of its decimal id."""
    hit = F.crc32(F.col(id).cast("string")) % 2 == 0
    return [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.when(hit, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))]


def report(df: DataFrame) -> DataFrame:
    """Per document its leaf, roots and proof, and whether its possibly tampered version leads to the root.

    A row without an id is not tampered with; for nulls, ties and empty tables see ``manifest``.
    """
    found = manifest(df, witness=tampered(df)).checked()
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified",
    )
