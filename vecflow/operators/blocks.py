"""Small numpy helpers used inside Arrow tasks: distances of two blocks, top-k merge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PAIRS_AT_ONCE = 1_000_000
STRIP = 16  # query rows whose sums over the dimensions stay in the cache
MOST_STEPS = np.iinfo(np.int16).max
LEAST_STEPS = 64  # with fewer steps per dimension whole numbers tell too little
MOST_PRODUCT = 1e30  # of two lengths, in single precision
MOST_ENTRIES = 64  # of a part's table, on average, for which all pairs are looked up by one product
MOST_MISSES = 8  # blocks after which small numbers are given up
ANGULAR = ("cosine", "correlation")
NO_LABEL = np.iinfo(np.int64).min


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a dense (rows, dim) matrix; ragged, null or not finite input is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("null vector or null vector element")
    if rows == 0:
        return np.zeros((0, 0))
    if len(flat) % rows or len(set(np.asarray(column.value_lengths()).tolist())) != 1:
        raise ValueError("vectors of different size")
    dense = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, -1)
    if pa.types.is_floating(flat.type) and not np.isfinite(dense).all():
        raise ValueError("vector element that is not a finite number")
    return dense


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "correlation":
        x = x - x.mean(axis=1, keepdims=True)
    if metric in ("cosine", "correlation"):
        lengths = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(lengths == 0, 1.0, lengths)
    return x


def rough(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, exact up to the rounding of the matrix product."""
    if metric in ("cosine", "correlation"):
        return 1.0 - q @ t.T
    if metric == "inner_product":
        return -(q @ t.T)
    if metric == "manhattan":
        return _sums(q, np.ascontiguousarray(t.T), np.float64)
    return (q * q).sum(axis=1)[:, None] + (t * t).sum(axis=1)[None, :] - 2.0 * (q @ t.T)


def _sums(q: np.ndarray, columns: np.ndarray, kind: type) -> np.ndarray:
    """Sums of absolute differences of all rows of ``q`` and all columns, a few rows at a time, which stay in the cache."""
    total = np.zeros((len(q), columns.shape[1]), dtype=kind)
    away = np.empty((STRIP, columns.shape[1]), dtype=kind)
    for at in range(0, len(q), STRIP):
        part, own = q[at : at + STRIP], total[at : at + STRIP]
        some = away[: len(part)]
        for d, column in enumerate(columns):
            np.subtract(part[:, d, None], column, out=some)
            np.abs(some, out=some)
            np.add(own, some, out=own)
    return total


class Products:
    """Distances by inner products of a block in single precision: ``base`` + score, off by at most what ``scores`` says per query."""

    scale = 1.0

    def __init__(self, train: np.ndarray, metric: str):
        self.base = 1.0 if metric in ANGULAR else 0.0
        self.longest = np.sqrt((train * train).sum(axis=1).max())
        if self.longest < MOST_PRODUCT:
            self.train = train.astype(np.float32)

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.sqrt((query * query).sum(axis=1)) * self.longest
        return (-query).astype(np.float32) @ self.train.T, lengths * (query.shape[1] + 4) * 2.0**-23 + 1e-30

    def holds(self, longest: float) -> bool:
        return max(self.longest, longest, self.longest * longest) < MOST_PRODUCT


class Steps:
    """L1 distances of a block in whole steps of 16 bits: ``scale`` * score, off by at most what rounding took from both vectors.

    All dimensions share the step; the sum of all dimensions fits the 16 bits.
    """

    base = 0.0

    def __init__(self, train: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.low = np.minimum(low, train.min(axis=0))
        span = (np.maximum(high, train.max(axis=0)) - self.low).max()
        self.levels = MOST_STEPS // max(1, train.shape[1])
        self.scale = span / max(1, self.levels) or 1.0
        if self.holds():
            codes, lost = self._codes(train)
            self.columns, self.lost = np.ascontiguousarray(codes.T), lost.max()

    def holds(self, longest: float = 0.0) -> bool:
        return self.levels >= LEAST_STEPS and bool(np.isfinite(self.scale))

    def _codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beside = vectors - self.low
        steps = np.minimum(np.rint(beside / self.scale), self.levels)
        return steps.astype(np.int16), np.abs(beside - steps * self.scale).sum(axis=1)

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, lost = self._codes(query)
        return _sums(codes, self.columns, np.int16), (lost + self.lost) / self.scale


def _limit(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Limits in the kind of the scores, never smaller (whole numbers: no score lies between)."""
    if kind == np.int16:
        return np.floor(np.clip(values, -1, MOST_STEPS)).astype(np.int16)
    return np.nextafter(values.astype(np.float32), np.float32(np.inf)) if kind == np.float32 else values


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of row pairs; the same two vectors give the same number in every block."""
    if metric in ("cosine", "correlation"):
        return 1.0 - (a * b).sum(axis=1)
    if metric == "inner_product":
        return -(a * b).sum(axis=1)
    if metric == "manhattan":
        return np.abs(a - b).sum(axis=1)
    return ((a - b) ** 2).sum(axis=1)


class TopK:
    """The k nearest train rows seen so far for each row of a query block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, skip_same: bool = False, bound=None):
        self.ids, self.k, self.metric, self.skip_same = ids, k, metric, skip_same
        self.vectors = prepared(vectors, metric)
        self.bound = np.full(len(ids), np.inf) if bound is None else np.asarray(bound, dtype=np.float64).copy()
        self.dist = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.label = np.zeros((len(ids), k), dtype=np.int64)
        self.misses = 0
        if self.vectors.size:
            self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
            self.longest = np.sqrt((self.vectors * self.vectors).sum(axis=1).max())

    def _small(self, train: np.ndarray) -> Products | Steps | None:
        """The block in small numbers, which tell pairs that are too far apart; None where they can't."""
        if self.misses > MOST_MISSES or not train.size or self.metric in ("l2", "euclidean"):
            return None
        block = Steps(train, self.low, self.high) if self.metric == "manhattan" else Products(train, self.metric)
        return block if block.holds(self.longest) else None

    def _same(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
        return self.ids[rows][:, None] == ids[None, :] if self.skip_same else None

    def _within(self, scores: np.ndarray, limit: np.ndarray, off: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs that can be among the k nearest, by scores that may be off by ``off`` of their row."""
        near = scores <= _limit(limit + off, scores.dtype)[:, None]
        if same is not None:
            near &= ~same
        few = np.count_nonzero(near) <= 16 * self.k * len(near)
        if few:
            row, col = np.divmod(np.flatnonzero(near), near.shape[1])
            each = np.bincount(row, minlength=len(near))
        else:
            each = np.count_nonzero(near, axis=1)
        loose = each > 4 * self.k
        if loose.any():  # the bounds known so far let much pass: tighten them with this block
            tight = scores[loose]
            if same is not None:
                tight[same[loose]] = np.iinfo(tight.dtype).max if tight.dtype.kind == "i" else np.inf
            best = np.partition(tight, self.k - 1, axis=1)[:, self.k - 1]
            near[loose] &= scores[loose] <= _limit(best + 2 * off[loose], scores.dtype)[:, None]
        if not few or loose.any():
            row, col = np.divmod(np.flatnonzero(near), near.shape[1])
        return row, col

    def add(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, asked: np.ndarray | None = None, cell: int | None = None) -> None:
        """Offers a block of train rows to all queries, or to the query rows in ``asked``; ``cell`` is the rows' inverted cell."""
        asked = np.arange(len(self.ids)) if asked is None else asked
        if len(ids) == 0 or len(asked) == 0:
            return
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError("vectors of different size")
        train = prepared(vectors, self.metric)
        small = self._small(train)
        largest, widest = (train * train).sum(axis=1).max(), np.abs(train).max(initial=0)
        step = max(1, PAIRS_AT_ONCE // len(ids))
        for at in range(0, len(asked), step):
            self._add_part(asked[at : at + step], ids, train, labels, small, largest, widest)

    def _add_part(self, rows, ids, train, labels, small, largest, widest):
        query = self.vectors[rows]
        largest = max(largest, (query * query).sum(axis=1).max(initial=0))
        widest = max(widest, np.abs(query).max(initial=0)) * query.shape[1]
        slack = 1e-12 * max(1.0, 4.0 * largest, widest)
        same, found = self._same(rows, ids), None
        if small is not None:
            scores, off = small.scores(query)
            found = self._within(scores, (self.bound[rows] + slack - small.base) / small.scale, off, same)
            if len(found[0]) > 4 * self.k * len(rows):
                self.misses, found = self.misses + 1, None
        if found is None:
            found = self._within(rough(query, train, self.metric), self.bound[rows] + slack, np.full(len(rows), slack / 2), same)
        row, col = found
        if len(row) == 0:
            return
        dist = np.empty(len(row))
        for at in range(0, len(row), PAIRS_AT_ONCE // 4):
            part = slice(at, at + PAIRS_AT_ONCE // 4)
            dist[part] = pairwise(query[row[part]], train[col[part]], self.metric)
        close = dist <= self.bound[rows[row]]
        if close.any():
            self._keep(rows, row[close], ids[col[close]], labels[col[close]], dist[close])

    def _keep(self, rows, row, near, label, dist):
        """Merges candidates into the lists of the queries that got any."""
        hit, local = np.unique(row, return_inverse=True)
        target = rows[hit]
        owner = np.concatenate([np.repeat(np.arange(len(hit)), self.k), local])
        dist = np.concatenate([self.dist[target].ravel(), dist])
        near = np.concatenate([self.near[target].ravel(), near])
        label = np.concatenate([self.label[target].ravel(), label])
        order = np.lexsort((near, dist, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        kept = rank < self.k
        place, order = (target[owner[kept]], rank[kept]), order[kept]
        self.dist[place], self.near[place], self.label[place] = dist[order], near[order], label[order]
        self.bound[target] = np.minimum(self.bound[target], self.dist[target, self.k - 1])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        row, rank = np.nonzero(np.isfinite(self.dist))
        dist = self.dist[row, rank]
        dist = np.sqrt(dist) if self.metric == "euclidean" else dist
        label = self.label[row, rank]
        columns = [
            pa.array(self.ids[row]), pa.array(self.near[row, rank]), pa.array(dist), pa.array(label, mask=label == NO_LABEL)
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass(frozen=True)
class ProductCodes:
    """What product codes stand for: per part a codebook, and the cell centres where codes are of the rest beside a centre."""

    books: list[np.ndarray]
    centres: np.ndarray | None = None


class CodeTopK(TopK):
    """The k nearest coded rows: distances of a query's parts to the codebook entries are looked up by code and summed.

    Codes are not turned into vectors. A query's table holds only entries that occur in the block, so it never is larger than
    the decoded block. Terms are summed in the order of the parts, so equal codes are equally far in every block. Where a part has
    few entries, all pairs are looked up at once, by a product of the tables with the codes as zeros and ones in single precision; pairs
    that it can't tell to be too far are looked up one by one.
    """

    def __init__(self, ids, vectors, k, metric, codes: ProductCodes, skip_same: bool = False, bound=None):
        super().__init__(ids, vectors, k, metric, skip_same, bound)
        self.codes = codes
        self.width = codes.books[0].shape[1]
        if len(ids) and self.vectors.shape[1] != self.width * len(codes.books):
            raise ValueError("vectors of different size")

    def add(self, ids, vectors, labels, asked=None, cell=None):
        asked = np.arange(len(self.ids)) if asked is None else asked
        if len(ids) == 0 or len(asked) == 0:
            return
        if vectors.shape[1] != len(self.codes.books):
            raise ValueError("codes of different size")
        used = [np.unique(part.astype(np.int64), return_inverse=True) for part in vectors.T]
        picks = self._picks(used, len(ids))
        largest = max(len(ids), self.width * max(len(entries) for entries, _ in used))
        step = max(1, PAIRS_AT_ONCE // largest)
        for at in range(0, len(asked), step):
            rows = asked[at : at + step]
            base, tables = self._tables(self.vectors[rows], used, None if self.codes.centres is None else self.codes.centres[cell])
            same, found = self._same(rows, ids), None
            if picks is not None:
                widest = sum(np.abs(t).max(axis=1) for t in tables)
                if (widest < MOST_PRODUCT).all():
                    off = (widest + np.abs(base[:, 0])) * (len(tables) + 4) * 2.0**-23 + 1e-30
                    found = self._within(np.hstack(tables).astype(np.float32) @ picks, self.bound[rows] - base[:, 0], off, same)
            if found is None:
                scores = self._summed(base, tables, [place for _, place in used])
                found = self._within(scores, self.bound[rows], np.zeros(len(rows)), same)
            row, col = found
            dist = base[row, 0]
            for table, (_, place) in zip(tables, used):
                dist = dist + table[row, place[col]]
            close = dist <= self.bound[rows[row]]
            if close.any():
                self._keep(rows, row[close], ids[col[close]], labels[col[close]], dist[close])

    def _picks(self, used: list, n: int) -> np.ndarray | None:
        """Per entry of the tables and row of the block whether the row has it; None where parts have many entries."""
        sizes = [len(entries) for entries, _ in used]
        if sum(sizes) > MOST_ENTRIES * len(sizes):
            return None
        found = np.zeros((sum(sizes), n), dtype=np.float32)
        for (_, place), first in zip(used, np.cumsum([0, *sizes])):
            found[first + place, np.arange(n)] = 1.0
        return found

    def _tables(self, query: np.ndarray, used: list, centre: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the sum of a query begins with, and its distances to the entries of each part."""
        product = self.metric == "inner_product"
        base = np.zeros((len(query), 1))
        if centre is not None and product:
            base = -(query * centre).sum(axis=1)[:, None]
        elif centre is not None:
            query = query - centre
        tables = []
        for j, (entries, _) in enumerate(used):
            part, book = query[:, None, j * self.width : (j + 1) * self.width], self.codes.books[j][entries][None]
            table = -(part * book) if product else np.abs(part - book) if self.metric == "manhattan" else (part - book) ** 2
            tables.append(table.sum(axis=2))
        return base, tables

    @staticmethod
    def _summed(base: np.ndarray, tables: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
        total = base
        for table, place in zip(tables, places):
            total = total + table[:, place]
        return total


def top_k(ids, vectors, k, metric, skip_same=False, bound=None, decode=None) -> TopK:
    """The list of best hits that fits how the train rows are stored."""
    if isinstance(decode, ProductCodes):
        return CodeTopK(ids, vectors, k, metric, decode, skip_same, bound)
    return TopK(ids, vectors, k, metric, skip_same, bound)
