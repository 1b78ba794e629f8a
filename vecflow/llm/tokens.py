"""Token files: ids under a static range asymmetric numeral system, in independent interleaved blocks."""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vecflow.llm.common import column, kept, sized, stored, trimmed
from vecflow.session import scratch_path

BITS = 20  # frequencies of the shared table add up to 2^BITS
LANES = 4096
BLOCK = 1 << 21  # ids after which a block is closed at the end of a document
STRIDE = 256  # rounds between checkpoints: a decoder can start at each
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
MAGIC = b"RANS1\0\0\0"
HEADER = "<8sIIQQIIII"  # magic, lanes, stride, ids, documents, words, crc of ids, crc of words, checkpoints
CACHE = 400_000
WORDS = 300_000  # of the table for many texts; the half that was used last outlives a full one
WORD_BYTES = 64  # longer ones do not outlive it
PORTION = 1 << 21  # bytes of text whose different pieces are looked up together


def shares(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that add up to 2^BITS; every id of the vocabulary keeps at least 1."""
    total, left = counts.sum(), (1 << BITS) - len(counts)
    if left < 0:
        raise ValueError("the vocabulary does not fit the table")
    exact = counts / total * left if total else np.full(len(counts), left / len(counts))
    out = np.floor(exact).astype(np.int64)
    order = np.lexsort((np.arange(len(counts)), -(exact - out)))
    out[order[: left - int(out.sum())]] += 1
    return out + 1


class Coder:
    """Encodes and decodes blocks under one table of frequencies."""

    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[bytes, int]:
        """Checkpoints and words of a block: id i is in lane i mod LANES; states after the last round come first."""
        rounds = -(-len(ids) // LANES)
        grid = np.zeros(rounds * LANES, np.int64)
        grid[: len(ids)] = ids
        frequency, start = self.frequency[grid].reshape(rounds, LANES), self.start[grid].reshape(rounds, LANES)
        limit = frequency << np.uint64(63 - BITS)
        states = np.full(LANES, LOW, np.uint64)
        words, marks, written = [], [], 0
        for t in range(rounds - 1, -1, -1):
            full = states >= limit[t]
            if full.any():
                words.append((states[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(words[-1])
                states = np.where(full, states >> np.uint64(32), states)
            quotient = states // frequency[t]
            states = (quotient << np.uint64(BITS)) + (states - quotient * frequency[t]) + start[t]
            if t % STRIDE == 0:
                marks.append((written, states))
        body = b"".join(x.tobytes() for x in reversed(words))
        points = b"".join(struct.pack("<I", written - at) + x.astype("<u8").tobytes() for at, x in reversed(marks))
        return points + body, len(marks)

    def decode(self, data: bytes, n: int, points: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids between two checkpoints; all by default."""
        size = 4 + 8 * LANES
        words = np.frombuffer(data, "<u4", offset=points * size).astype(np.uint64)
        rounds = -(-n // LANES)
        if first >= points:
            return np.zeros(0, np.uint32)
        at = struct.unpack_from("<I", data, first * size)[0]
        states = np.frombuffer(data, "<u8", LANES, first * size + 4).astype(np.uint64)
        begin, end = first * STRIDE, min(rounds, (points if last is None else last) * STRIDE)
        out = np.empty((end - begin, LANES), np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for t in range(end - begin):
            slot = states & mask
            out[t] = found = self.symbol[slot]
            states = self.frequency[found] * (states >> np.uint64(BITS)) + slot - self.start[found]
            low = np.flatnonzero(states < LOW)
            if len(low):
                states[low] = (states[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
        return out.ravel()[: max(0, min(n, end * LANES) - begin * LANES)]


def pack(coder: Coder, documents: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A block of the file format: header, document numbers, which are null, lengths, checkpoints, words."""
    body, points = coder.encode(ids)
    known = np.array([d is not None for d in documents], np.uint8)
    index = np.array([d or 0 for d in documents], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes()
    head = struct.pack(HEADER, MAGIC, LANES, STRIDE, len(ids), len(documents), len(body), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(index + body), points)
    return head + index + body


def unpack(coder: Coder, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document numbers, lengths and ids of a block; raises if a checksum disagrees."""
    magic, lanes, _, n, documents, size, crc, whole, points = struct.unpack_from(HEADER, block)
    if magic != MAGIC or lanes != LANES or zlib.crc32(block[struct.calcsize(HEADER) :]) != whole:
        raise ValueError("the block is damaged")
    at = struct.calcsize(HEADER)
    numbers = np.frombuffer(block, "<i8", documents, at)
    known = np.frombuffer(block, np.uint8, documents, at + 8 * documents)
    lengths = np.frombuffer(block, "<u8", documents, at + 9 * documents).astype(np.int64)
    ids = coder.decode(block[at + 17 * documents :], n, points)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of the block are damaged")
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, ids


def every(kind: str) -> str:
    """The characters of a class of a regular expression, up to the last Latin letter that the encoder knows."""
    return "".join(re.findall(f"[{kind}]", "".join(map(chr, range(0x250)))))


class Encoder:
    """The tokenizers library behind a table of whole words.

    A blank between two visible characters always begins a new piece in byte-level pre-tokenisation, and so does a line end that
    neither ends a run of white space nor is followed by a blank, so a text may be cut there and each piece be looked up. A new
    piece of letters, digits, ASCII marks and single line ends is put together from its runs of these, the units that the
    library's model merges alone; any other is encoded by the whole library.
    """

    SAFE = "!-~¡-ɏ"
    # texts that are not cut at every blank and line end; \z is the very end in Arrow's expressions
    ODD = rf"[^ \n{SAFE}]|[ \n] | \n|\A | \z|\n\n\n|\n\n\z"
    CUT = re.compile(rf"(?<=[{SAFE}]) (?=[{SAFE}])")
    LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"  # marks without the apostrophe, which begins units of its own
    WORD = re.compile(rf"([{LETTERS}]+)([{MARKS}]*)")
    MARKED = rf"\A\n?[{LETTERS}]+[{MARKS}]+\z"
    FRONTS, ENDS = "\n" + every(LETTERS), every(MARKS)
    PLAIN = re.compile(rf"[{LETTERS}0-9{MARKS}\n]+")
    RUN = re.compile(rf"[{LETTERS}]+|[0-9]+|[{MARKS}]+|\n")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.odd = "|".join([self.ODD, *map(re.escape, self.special)])
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.words, self.used, self.turn = pa.array([], pa.string()), np.zeros(0, np.int64), 0  # of many texts, and when last met
        self.coded, self.starts = np.zeros(0, self.type), np.zeros(1, np.int64)  # their ids and where each begins; the end comes last

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def merged(self, text: str) -> bytes:
        """The ids of one unit, by the library's model; a text of one unit needs no splitting."""
        shown = "Ġ" + text[1:] if text[:1] == " " and text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def run(self, text: str) -> bytes:
        found = self.runs.get(text)
        if found is None:
            if len(self.runs) >= CACHE:
                self.runs.clear()
            found = self.runs[text] = self.merged(text)
        return found

    def piece(self, text: str) -> bytes:
        """The ids of a piece, kept; a full table becomes the older one."""
        found = self.pieces.get(text)
        if found is None:
            found = self.older.get(text) or self.made(text)
            if len(self.pieces) >= CACHE:
                self.older, self.pieces = self.pieces, {}
            self.pieces[text] = found
        return found

    def made(self, text: str) -> bytes:
        """The ids of a piece; a blank stands before it unless it begins with a line end."""
        if text.isascii() and text.isalpha():
            return self.merged(" " + text)
        if word := self.WORD.fullmatch(text):
            return self.piece(word[1]) + self.run(word[2]) if word[2] else self.merged(" " + text)
        if not self.PLAIN.fullmatch(text) or "\n\n" in text:
            return self.ids(text if text[0] == "\n" else " " + text)
        first, *rest = self.RUN.findall(text)
        return (self.run(first) if first == "\n" else self.merged(" " + first)) + b"".join([self.run(r) for r in rest])

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of ``type``."""
        if any(s in text for s in self.special):
            return self.ids(text)
        head, *rest = self.CUT.split(text)
        return (self.ids(head) if head else b"") + b"".join(map(self.piece, rest))

    def encode_all(self, column: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, null as empty, and ``end`` after them.

        Texts are cut into pieces, words are parted from the marks behind them, and each different one is looked up once.
        """
        column = pc.fill_null(column.cast(pa.string()), "")
        odd = pc.match_substring_regex(column, self.odd)
        whole = {row: self.encode(column[row].as_py()) for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", column), "\n", " \n"), " ")
        values, bounds, rows = cut.flatten(), cut.offsets.to_numpy(), len(cut)
        inner = np.ones(len(values), bool)
        inner[bounds[:-1]] = False  # a text's first piece has no blank before it
        heads = values.take(pa.array(bounds[:-1])).to_pylist()
        pieces = values.filter(pa.array(inner)).dictionary_encode()
        del column, cut, values

        marked = pc.match_substring_regex(pieces.dictionary, self.MARKED)
        words = pc.if_else(marked, pc.utf8_rtrim(pieces.dictionary, self.ENDS), pieces.dictionary).dictionary_encode()
        marks = pc.if_else(marked, pc.utf8_ltrim(pieces.dictionary, self.FRONTS), "").dictionary_encode()
        known = self.looked_up(words.dictionary)
        ends, begin = self.flat([self.run(x) if x else b"" for x in marks.dictionary.to_pylist()])
        two = np.stack([known[words.indices.to_numpy()], marks.indices.to_numpy() + len(self.words)], 1).ravel()
        parts, starts = chosen(np.concatenate([self.coded, ends]), np.concatenate([self.starts[:-1], begin + len(self.coded)]), two)

        first, others = self.flat([whole[row] if row in whole else self.ids(x) if x else b"" for row, x in enumerate(heads)] + [end])
        n = len(pieces.dictionary)
        entry = np.empty(len(inner), np.int32)
        entry[inner] = pieces.indices.to_numpy()
        entry[~inner] = np.arange(n, n + rows)
        entry = np.insert(entry, bounds[1:], n + rows)
        ids, ends = chosen(np.concatenate([parts, first]), np.concatenate([starts[: 2 * n : 2], others + len(parts)]), entry)
        edges = ends[np.concatenate([[0], bounds[1:] + np.arange(1, rows + 1)])] * self.type.itemsize
        return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(edges), pa.py_buffer(ids)]).cast(pa.binary())

    def looked_up(self, words: pa.Array) -> np.ndarray:
        """Where different words stand in the table; those not in it are added, after those used longest ago have left a full one."""
        if len(self.words) > WORDS or self.words.nbytes > WORDS * WORD_BYTES:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: WORDS // 2])
            keep = keep[pc.binary_length(self.words).to_numpy()[keep] <= WORD_BYTES]
            self.words, self.used = self.words.take(pa.array(keep)), self.used[keep]
            self.coded, self.starts = chosen(self.coded, self.starts, keep)
        found = pc.index_in(words, value_set=self.words)
        missing = found.is_null()
        fresh = words.filter(missing)
        ids, starts = self.flat([self.made(x) for x in fresh.to_pylist()])
        at = pc.fill_null(found, 0).to_numpy().copy()
        at[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(self.words) + len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.starts = np.concatenate([self.starts[:-1], starts + len(self.coded)])
        self.coded = np.concatenate([self.coded, ids])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.turn += 1
        self.used[at] = self.turn
        return at

    def flat(self, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries in one array, and where each begins; the end comes last."""
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.type.itemsize
        return np.frombuffer(b"".join(table), self.type), np.concatenate([[0], np.cumsum(sizes)])


def chosen(ids: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries one after another, and where each begins; the end comes last."""
    n = np.diff(starts).astype(np.int32)[entries]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    out = np.empty(ends[-1], ids.dtype)
    for a in range(0, len(entries), 1 << 16):  # places are 8 bytes an id
        b = min(a + (1 << 16), len(entries))
        at = np.repeat(starts[entries[a:b]] - ends[a:b], n[a:b])
        at += np.arange(ends[a], ends[b])
        np.take(ids, at, out=out[ends[a] : ends[b]], mode="clip")
    return out, ends


def encoder(path: str) -> Encoder:
    """One per worker process, for all its tasks. Functions travel by value, so it is kept in a module of the worker's own."""
    own = sys.modules.setdefault("_vecflow_worker", types.ModuleType("_vecflow_worker"))
    found = vars(own).setdefault("encoders", {})
    if path not in found:
        found[path] = Encoder(path)
    return found[path]


def portions(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PORTION bytes of a text column, whole rows each."""
    for batch in batches:
        done = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy().astype(np.int64)) // PORTION
        edges = [0, *(np.flatnonzero(np.diff(done)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int | None = 2) -> tuple[DataFrame, np.ndarray]:
    """Stored (id, ids) of all rows, the end id included, and the corpus counts of every id."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = counts = None
        for batch in portions(batches, "text"):
            if work is None:
                work = encoder(path)
                counts = np.zeros(work.size, np.int64)
                end = b"" if end_id is None else np.array([end_id], work.type).tobytes()
            coded = work.encode_all(column(batch, "text"), end)
            counts += np.bincount(np.frombuffer(coded.buffers()[2], work.type), minlength=work.size)
            yield pa.RecordBatch.from_arrays([batch.column(0), coded, pa.nulls(len(coded), pa.list_(pa.int64()))], ["id", "ids", "total"])
        if work is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))], ["id", "ids", "total"])

    seen = stored(rows.mapInArrow(trimmed(run), "id long, ids binary, total array<long>"), "ids", compression="zstd")
    size = encoder(path).size
    counts = np.zeros(size, np.int64)  # as large as the vocabulary
    for r in seen.where("total IS NOT NULL").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        counts[r["pos"]] = r["n"]
    return seen.where("total IS NULL").select("id", "ids"), counts


def write(df: DataFrame, target: str, path: str, id: str = "doc_id", text: str = "text", end_id: int | None = 2, ids_per_file: int = 1 << 22) -> None:
    """Token files below ``target``: blocks in ascending order of id, and the table of frequencies they share.

    Every row is written, repeated ones and those without an id (first) too; ties are ordered by their ids. A null text is
    empty and holds the end id only; no rows give no blocks; other columns are not read. A block holds whole documents and
    is closed at the first document end after ``BLOCK`` ids, so a very long text has a long block with many checkpoints.
    """
    spark = df.sparkSession
    coded, counts = encode(df, path, id, text, end_id)
    spark.createDataFrame(pa.table({"id": np.arange(len(counts)), "frequency": shares(counts)})).coalesce(1).write.parquet(f"{target}/table")
    shared = spark.sparkContext.broadcast(shares(counts))
    wide = len(counts) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, coder = TaskContext.get().partitionId(), 0, None
        documents, held, total = [], [], 0
        kind = np.dtype("<u4" if wide else "<u2")

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            data = pack(coder, documents, [len(x) // kind.itemsize for x in held], ids.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "block", "n_ids", "data"],
            )

        for batch in batches:
            coder = coder or Coder(shared.value)
            for number, ids in zip(column(batch, "id").to_pylist(), column(batch, "ids").to_pylist()):
                documents.append(number)
                held.append(ids)
                total += len(ids) // kind.itemsize
                if total >= BLOCK:
                    yield closed()
                    documents, held, total, block = [], [], 0, block + 1
        if held:
            yield closed()

    parts = max(1, int(counts.sum()) // ids_per_file)
    # Spark samples the keys of the ranges to the driver: a few ids of a text stand for all of them
    ordered = coded.repartitionByRange(parts, F.col("id"), F.substring("ids", 1, 64)).sortWithinPartitions("id", "ids")
    blocks = ordered.mapInArrow(trimmed(run), "part int, block int, n_ids long, data binary")
    blocks.write.option("compression", "none").parquet(f"{target}/blocks")


def read(spark: SparkSession, target: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) per document of token files; ``ids`` are little-endian 32-bit integers.

    Blocks are decoded on their own, in any task. ``start`` adds the document's place in its block to the ids of all blocks
    before: a window over the blocks of each file and one over the files' sums.
    """
    table = spark.read.parquet(f"{target}/table").orderBy("id").collect()  # as large as the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r["frequency"] for r in table], np.int64))
    blocks = spark.read.schema("part int, block int, n_ids long, data binary").parquet(f"{target}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part, block, data in zip(*(column(batch, c).to_pylist() for c in ("part", "block", "data"))):
                coder = coder or Coder(shared.value)
                numbers, lengths, ids = unpack(coder, data)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                pieces = [raw[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(numbers), pa.int32()),
                        pa.array([block] * len(numbers), pa.int32()),
                        pa.array(numbers, pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                        pa.array(pieces, pa.binary()),
                    ],
                    ["part", "block", "id", "offset", "n_tokens", "ids_crc32", "ids"],
                )

    sizes = blocks.select("part", "block", "n_ids")
    files = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("blocks"))
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = kept(files.select("part", before("n", Window.orderBy("part")).alias("ahead"), "blocks"))
    inside = sizes.select("part", "block", before("n_ids", Window.partitionBy("part").orderBy("block")).alias("inside"))
    starts = kept(inside.join(sized(ahead, ahead.count()), "part").select("part", "block", (F.col("ahead") + F.col("inside")).alias("before")))
    rows = blocks.select("part", "block", "data").mapInArrow(run, "part int, block int, id long, offset long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(sized(starts, starts.count()), ["part", "block"]).select("id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(df: DataFrame, path: str, **options) -> DataFrame:
    """Documents written to token files below the shared folder, and what the files hold of each."""
    target = scratch_path(df.sparkSession, "tokens")
    write(df, target, path, **options)
    return read(df.sparkSession, target).select(F.col("id").alias(options.get("id", "doc_id")), "start", "n_tokens", "ids_crc32")
