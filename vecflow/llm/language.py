"""Language identification by evidence fusion: text, declared language, address and host priors."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vecflow.llm.common import free_names, kept, map_batches, map_groups, sized, stored, texts, uniform

CELLS = 1 << 16  # hashed byte trigrams
CHUNK = 1 << 19  # bytes scored at once
LEAST_ROWS = 20  # a label's share of the sample is at least this
FULL_WEIGHT = 2_000  # a longer text counts for so many trigrams in a fit, spread over all of it
SATURATION = 200.0  # a text counts for at most so many independent trigrams
UNKNOWN = "und"
UNKNOWN_ODDS = -10.4  # per trigram: a text that no model explains better is of no known language
STRENGTH = 5.0  # rows that the level above counts for
SCORED = "n long, scores array<double>"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)

HIDDEN = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    """The text of a page without markup."""
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def trigrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all byte trigrams of the texts' letters, and the text that each is from; other characters are one blank."""
    data = [b" %b " % x.encode("utf-8", "surrogatepass") for x in rows]
    code = _FOLD[np.frombuffer(b"".join(data), np.uint8)]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in data])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    code, owner = code[keep].astype(np.uint32), owner[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = ((code[:-2] * 31 + code[1:-1]) * 1009 + code[2:]) * np.uint32(2654435761) >> np.uint32(16)
    inside = (owner[:-2] == owner[2:]) & (code[1:-1] != 32)
    return cell[inside].astype(np.int64), owner[:-2][inside]


def chunks(rows: list[str]):
    """Slices of the texts of about CHUNK characters; a longer text is one slice."""
    start = size = 0
    for i, x in enumerate(rows):
        size += len(x)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


class Model:
    """Log odds of hashed trigrams per language, the unknown one last."""

    def __init__(self, languages: list[str], odds: np.ndarray):
        self.languages, self.odds = languages, odds

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray) -> Model:
        odds = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * CELLS))
        return cls([*languages, UNKNOWN], np.vstack([odds, np.full((1, CELLS), UNKNOWN_ODDS)]).astype(np.float32))

    def score(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of trigrams and damped log likelihood per language of each text."""
        n, scores = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(self.languages)))
        for a, b in chunks(rows):
            cell, owner = trigrams(rows[a:b])
            n[a:b] = np.bincount(owner, minlength=b - a)
            for k in range(len(self.languages)):
                scores[a:b, k] = np.bincount(owner, self.odds[k][cell], b - a)
        return n, scores / (1 + n[:, None] / SATURATION)


def sampled(df: DataFrame, id: str, text: str, label: str, rows: int, seed: int) -> tuple[list[str], DataFrame]:
    """All labels, and about ``rows`` different labelled rows (label, text, draw): an even share of each label or all it has.

    A row is drawn by a hash of its id and text, so rows without an id and rows of a repeated id are drawn one by one;
    copies count once.
    """
    labelled = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), uniform(seed, F.col(id), F.col(text)).alias("draw"))
    found = labelled.select("label", "draw").distinct().groupBy("label").count().orderBy("label").collect()
    left, open_, share = rows, len(found), 0.0
    for n in sorted(r["count"] for r in found):
        share = max(left / open_, LEAST_ROWS)
        if n > share:
            break
        left, open_ = left - n, open_ - 1
    cut = [F.lit(x) for r in found if r["count"] > share for x in (r["label"], share / r["count"])]
    if cut:
        labelled = labelled.where(F.col("draw") < F.coalesce(F.try_element_at(F.create_map(*cut), F.col("label")), F.lit(1.0)))
    return [r["label"] for r in found], labelled.dropDuplicates(["label", "draw"])


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", rows: int = 2_000, seed: int = 3) -> Model:
    """A model of every label, fitted on about ``rows`` labelled rows; only per-language counts leave the tasks.

    Without labelled rows the model knows no language, and every row is rejected.
    """
    languages, sample = sampled(df, id, text, label, rows, seed)

    def work(table: pa.Table) -> pa.RecordBatch:
        counts = np.zeros(CELLS)
        found = [x or "" for x in table["text"].to_pylist()]
        for a, b in chunks(found):
            cell, owner = trigrams(found[a:b])
            weight = 1 / np.maximum(1, np.bincount(owner, minlength=b - a) / FULL_WEIGHT)
            counts += np.bincount(cell, weight[owner], CELLS)
        return pa.RecordBatch.from_arrays([table["label"].combine_chunks().slice(0, 1), pa.array([counts.astype("<f8").tobytes()], pa.binary())], ["label", "counts"])

    found = {r["label"]: r["counts"] for r in map_groups(sample, ["label"], ["draw"], lambda: work, "label string, counts binary").collect()}
    counts = np.array([np.frombuffer(found[x], "<f8") if x in found else np.zeros(CELLS) for x in languages]).reshape(len(languages), CELLS)
    return Model.of(languages, counts)


def evidence(df: DataFrame, model: Model, row: Column, text: Column, declared: Column, address: Column, markup: bool = False) -> DataFrame:
    """(row, declared, path, host, domain, suffix, n, scores): all that a row says about its language.

    The address gives the host, its last two labels, its last label, and a two-letter code at the head of its path; an
    address without a scheme is a host. Null texts are empty, null or unknown codes say nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.odds))

    def make():
        found = Model(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = texts(batch, "text")
            n, scores = found.score([visible(x) for x in said] if markup else said)
            return pa.RecordBatch.from_arrays(
                [*(c for c, f in zip(batch.columns, batch.schema) if f.name != "text"), pa.array(n), pa.array(list(scores), pa.list_(pa.float64()))],
                [*(f.name for f in batch.schema if f.name != "text"), "n", "scores"],
            )

        return work

    if markup:
        declared = F.regexp_extract(text, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    code = lambda c: F.when(F.lower(c).isin(model.languages), F.lower(c))
    host = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1))
    rows = df.select(
        row.alias("row"),
        code(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)).alias("declared"),
        code(F.regexp_extract(F.coalesce(address, F.lit("")), r"^[A-Za-z0-9+.-]+://[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", 1)).alias("path"),
        host.alias("host"),
        text.alias("text"),
    )
    rows = rows.withColumns({"domain": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1), "suffix": F.regexp_extract("host", r"\.([^.]*)$", 1)})
    rows = rows.select("row", "declared", "path", "host", "domain", "suffix", "text")
    kind = rows.schema["row"].dataType.simpleString()
    return map_batches(rows, make, f"row {kind}, declared string, path string, host string, domain string, suffix string, {SCORED}")


def softmax(scores: Column) -> Column:
    best = F.array_max(scores)
    odds = F.transform(scores, lambda s: F.exp(s - best))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))


class Priors:
    """What the whole table says about its hosts and codes, by grouped sums of the texts' posteriors."""

    def __init__(self, seen: DataFrame, languages: list[str]):
        self.languages = languages
        size = range(len(languages))
        posterior = seen.withColumn("p", softmax(F.col("scores"))).where("n > 0")
        sums = lambda names: [F.sum(F.col(n)).alias(n) for n in names]
        names = [f"s{k}" for k in size]
        parts = [F.get("p", F.lit(k)).alias(f"s{k}") for k in size]
        rows = posterior.select("declared", "path", "host", "domain", "suffix", *parts)
        hosts = kept(rows.groupBy("host", "domain", "suffix").agg(*sums(names)))
        domains = hosts.groupBy("domain", "suffix").agg(*sums(names))
        suffixes = kept(domains.groupBy("suffix").agg(*sums(names)))
        total = suffixes.agg(*sums(names)).first()
        whole = sum(total[n] or 0.0 for n in names)
        top = [((total[n] or 0.0) + 1) / (whole + len(languages)) for n in names]
        # each level counts its own rows and STRENGTH rows of the level above
        under = lambda above: F.array(*((F.col(f"s{k}") + STRENGTH * above(k)) / (sum(map(F.col, names)) + STRENGTH) for k in size))
        by_suffix = suffixes.select("suffix", under(lambda k: F.lit(top[k])).alias("above"))
        by_domain = domains.join(by_suffix, "suffix").select("domain", under(lambda k: F.get("above", F.lit(k))).alias("above"))
        self.hosts = kept(hosts.join(by_domain, "domain").select("host", F.array(*names).alias("sums"), "above"))
        self.count = self.hosts.count()
        self.top = top
        # P(code | language): a table of languages squared
        self.codes = {c: self._confusion(rows, c, names) for c in ("declared", "path")}

    def _confusion(self, rows: DataFrame, code: str, names: list[str]) -> list[list[float]]:
        found = {r[code]: [r[n] for n in names] for r in rows.where(F.col(code).isNotNull()).groupBy(code).agg(*(F.sum(n).alias(n) for n in names)).collect()}
        table = np.array([found.get(x, [0.0] * len(names)) for x in self.languages]) + 0.5
        return np.log(table / table.sum(axis=0)).tolist()

    def decide(self, seen: DataFrame, least: float) -> DataFrame:
        """Adds ``found`` (lang, confidence, text_lang, kept); the row's own share is taken out of its host's sums."""
        rows = seen.join(sized(self.hosts, self.count), "host", "left")
        own = softmax(F.col("scores"))
        prior = F.array(*(F.lit(x) for x in self.top))
        rows = rows.withColumn("own", F.when(F.col("n") > 0, own).otherwise(F.transform("scores", lambda _: F.lit(0.0))))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        others = F.zip_with("sums", "own", lambda s, o: F.greatest(s - o, F.lit(0.0)))
        rows = rows.withColumns({"others": others, "above": F.coalesce("above", prior)})
        rows = rows.withColumn("others", F.coalesce("others", F.transform("above", lambda _: F.lit(0.0))))
        rows = rows.withColumn("weight", total(F.col("others")) + STRENGTH)
        host = F.zip_with("others", "above", lambda o, a: F.log((o + STRENGTH * a)))
        neutral = F.transform("scores", lambda _: F.lit(0.0))

        def said(code: str) -> Column:
            out = neutral
            for language, row in zip(self.languages, self.codes[code]):
                out = F.when(F.col(code) == language, F.array(*map(F.lit, row))).otherwise(out)
            return out

        rows = rows.withColumns({"host_odds": host, "declared_odds": said("declared"), "path_odds": said("path")})
        add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
        fused = add(add(F.col("scores"), F.col("host_odds")), add(F.col("declared_odds"), F.col("path_odds")))
        rows = rows.withColumn("fused", softmax(fused))
        names = F.array(*map(F.lit, self.languages))
        best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
        lang, sure = best(F.col("fused")), F.array_max("fused")
        found = F.struct(
            F.when(F.col("n") > 0, lang).otherwise(UNKNOWN).alias("lang"),
            sure.alias("confidence"),
            F.when(F.col("n") > 0, best(F.col("scores"))).alias("text_lang"),
            "declared",
            "n",
            ((F.col("n") > 0) & (lang != UNKNOWN) & (sure >= least)).alias("kept"),
        )
        return rows.select("row", found.alias("found"))


def identify(seen: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(row, found): the language of each row of a stored evidence table.

    Log posterior = damped text likelihood + host prior + P(declared code | language) + P(path code | language). The host's
    prior is its other rows' posteriors, smoothed by its domain's, its suffix's and the whole table's. A row without
    letters is of no known language and not kept; so is one whose text no model explains, or whose best language stays
    below ``least``. Repeated rows and rows without an id are rows; no rows give no rows.
    """
    return Priors(seen, model.languages).decide(seen, least)


def documents(df: DataFrame, model: Model, row: Column, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    return evidence(df, model, row, F.col(text), F.col(lang), F.col(source))


def pages(df: DataFrame, model: Model, row: Column, page: str = "html", address: str = "url") -> DataFrame:
    return evidence(df, model, row, F.col(page), F.lit(None).cast("string"), F.col(address), markup=True)


def accepted(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: float = 0.5) -> DataFrame:
    """The rows whose language is found, in their own columns, with that language in ``lang``.

    Rows are told apart by two hashes of id, text, language and source. Only those that are rejected or get another
    language are joined back, by broadcast up to a counted size, so that texts usually are not shuffled.
    """
    model = fit(df, id, text, lang)
    free = free_names(df, 3)
    keys = {free[seed]: F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (id, text, lang, source))) for seed in (1, 2)}
    judged = free[0]
    row = F.struct(*(c.alias(k) for k, c in keys.items()), F.col(lang).alias("lang"))
    found = identify(stored(documents(df, model, row, text, lang, source), "evidence"), model, least)
    other = found.where(~F.col("found.kept") | ~F.col("found.lang").eqNullSafe(F.col("row.lang")))
    other = kept(other.select(*(f"row.{k}" for k in keys), F.struct("found.kept", "found.lang").alias(judged)).distinct())
    out = df.withColumns(keys).join(sized(other, other.count()), list(keys), "left").where(F.col(judged).isNull() | F.col(f"{judged}.kept"))
    return out.select(*(F.coalesce(f"{judged}.lang", F.col(lang)).alias(c) if c == lang else F.col(f"`{c}`") for c in df.columns))
