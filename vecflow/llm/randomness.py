"""Secret scans: known forms, and a battery of randomness tests with false-discovery control per length."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.llm.common import column, map_batches, stored, texts

# fixed values: the known forms; letters of the assignment in either case
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = ["assign", "access", "hex", "random"]
FORMS = [
    (re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    (re.compile(r"[0-9a-f]{32,}"), 0, 32),
]
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

# alphabets from the narrowest; a run is read in the first that holds it
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "base64url": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}
CLASSES = 64  # character classes of ordinary text: 26 + 26 letters, digits by ten, + / - _ by two
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    _CODE[ord(_c)] = _i
for _c, _i in (("+", 62), ("/", 62), ("-", 63), ("_", 63)):
    _CODE[ord(_c)] = _i
LENGTHS = (16, 24, 32, 48, 64, 128)  # lower ends of the length classes
BINS = 400


def known(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the known forms, leftmost and without overlap per kind."""
    found = []
    for kind, (form, group, least) in enumerate(FORMS):
        found += [(m.start(), kind, m.end()) for m in form.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> float:
    """How well a run agrees with uniform draws from its encoding's alphabet: the smallest p of three tests, times three.

    Chi-squared over equal parts of the alphabet, runs above and below its middle, correlation of neighbours. 0 if
    no encoding holds the run.
    """
    body = token.rstrip("=")
    alphabet = next((a for a in ALPHABETS.values() if set(body) <= set(a)), None)
    if alphabet is None:
        return 0.0
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in body], float)
    n, size = len(x), len(alphabet)
    parts = max(2, min(size, n // 4))
    while size % parts and parts > 2:
        parts -= 1
    observed = np.bincount((x * parts // size).astype(int), minlength=parts)
    expected = np.array([np.sum(np.arange(size) * parts // size == i) for i in range(parts)]) * n / size
    chi, free = float(((observed - expected) ** 2 / expected).sum()), parts - 1
    # Wilson-Hilferty; only too uneven counts speak against randomness
    p_chi = 0.5 * math.erfc((((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))) / math.sqrt(2))
    high = x >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if not ups or not downs:
        return 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ups * downs / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = normal_tail((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0
    spread = x - x.mean()
    p_serial = normal_tail(float((spread[1:] * spread[:-1]).sum() / (spread**2).sum()) * math.sqrt(n))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def neighbours(data: bytes) -> np.ndarray:
    """Counts of neighbouring characters inside runs of the alphabets' characters."""
    code = _CODE[np.frombuffer(data, np.uint8)].astype(np.int32)
    first, second = code[:-1], code[1:]
    both = (first < CLASSES) & (second < CLASSES)
    return np.bincount(first[both] * CLASSES + second[both], minlength=CLASSES * CLASSES)


def surprise(token: str, odds: np.ndarray) -> float:
    """log10 of a valid p-value for "ordinary text": ordinary over uniform likelihood of the run's characters."""
    code = _CODE[np.frombuffer(token.rstrip("=").encode(), np.uint8)]
    alphabet = next(len(a) for a in ALPHABETS.values() if set(token.rstrip("=")) <= set(a))
    return min(0.0, float(odds[code[:-1], code[1:]].sum() + (len(code) - 1) * math.log(alphabet)) / math.log(10))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", min_random: float = 0.01, false_share: float = 0.01) -> DataFrame:
    """(id, spans array<struct<kind,start,end>>): the known forms and the runs that the battery takes for secrets.

    A run of 16 or more characters that meets no known form is a candidate if all three tests agree with uniform draws
    (``min_random``). Its p-value is how likely ordinary text writes it, by the character pairs of the whole corpus;
    within each length class, p-values of all runs pass a step-up control at ``false_share`` (Benjamini-Hochberg on
    p-values rounded up to tenths of a decade). Places are code points, end exclusive. A null text is empty and has no
    spans; repeated rows and rows without an id each give a row; no rows give no rows; other columns are not read.
    Whole texts are read once; per document only its spans are stored, the counts have a fixed size.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, runs, quiet = [], [], np.zeros(len(LENGTHS), np.int64)
        rows = texts(batch, "text")
        for x in rows:
            found = known(x)
            spans.append([{"kind": k, "start": s, "end": e} for s, k, e in found])
            loose = []
            for m in RUN.finditer(x):
                if any(s < m.end() and m.start() < e for s, _, e in found):
                    continue
                if (p := battery(m[0])) >= min_random:
                    loose.append({"start": m.start(), "end": m.end(), "token": m[0], "p": p})
                else:
                    quiet[length_class(len(m[0]))] += 1
            runs.append(loose)
        pairs = sum((neighbours(x.encode("utf-8", "surrogatepass")) for x in rows), np.zeros(CLASSES * CLASSES, np.int64))
        ids = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
        total = [None] * len(rows) + [list(map(int, np.concatenate([quiet, pairs])))]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([*spans, None], pa.list_(span)), pa.array([*runs, None], pa.list_(run)), pa.array(total, pa.list_(pa.int64()))],
            ["id", "spans", "runs", "total"],
        )

    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("p", pa.float64())])
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:int,start:long,end:long>>, runs array<struct<start:long,end:long,token:string,p:double>>, total array<long>"
    seen = stored(map_batches(rows, lambda: work, schema), "runs")

    # fixed size: a number per length class and per pair of characters
    sums = seen.where("total IS NOT NULL").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("n"))
    counts = np.zeros(len(LENGTHS) + CLASSES * CLASSES)
    for r in sums.collect():
        counts[r["pos"]] = r["n"]
    quiet, pairs = counts[: len(LENGTHS)], counts[len(LENGTHS) :].reshape(CLASSES, CLASSES)
    odds = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * CLASSES))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for loose in column(batch, "runs").to_pylist():
            out.append([{"start": r["start"], "end": r["end"], "long": length_class(r["end"] - r["start"]), "bin": level(surprise(r["token"], odds))} for r in loose or []])
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("long", pa.int32()), ("bin", pa.int32())])
        return pa.RecordBatch.from_arrays([batch.column(0), column(batch, "spans"), pa.array(out, pa.list_(kind))], ["id", "spans", "runs"])

    judged = map_batches(
        seen.where("total IS NULL").select("id", "spans", "runs"),
        lambda: judge,
        f"id {kind}, spans array<struct<kind:int,start:long,end:long>>, runs array<struct<start:long,end:long,long:int,bin:int>>",
    )
    # at most classes x bins rows
    found = judged.where(F.size("runs") > 0).select(F.inline("runs")).groupBy("long", "bin").count().collect()
    least = thresholds({(r["long"], r["bin"]): r["count"] for r in found}, quiet, false_share)
    limit = F.array(*(F.lit(x) for x in least))
    secrets = F.filter("runs", lambda r: r["bin"] >= F.get(limit, r["long"]))
    added = F.transform(secrets, lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    spans = F.transform(F.concat("spans", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = F.transform(F.array_sort(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return judged.select(F.col("id").alias(id), ordered.alias("spans"))


def length_class(length: int) -> int:
    return sum(length >= x for x in LENGTHS) - 1


def level(log10_p: float) -> int:
    """Tenths of a decade, so that the p-value of a level is at least that of its runs."""
    return min(BINS, int(-10 * log10_p))


def thresholds(found: dict[tuple[int, int], int], quiet: np.ndarray, false_share: float) -> list[int]:
    """Per length class the lowest level that the step-up procedure accepts; above all levels if none is."""
    out = []
    for long in range(len(LENGTHS)):
        levels = {b: n for (c, b), n in found.items() if c == long}
        tests, passed, least = sum(levels.values()) + quiet[long], 0, BINS + 1
        for b in sorted(levels, reverse=True):
            passed += levels[b]
            if tests * 10 ** (-b / 10) <= false_share * passed:
                least = b
        out.append(least)
    return out


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts per known form, the hash of their spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id,
        *(number(i).alias(f"n_{name}") for i, name in enumerate(KINDS)),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
