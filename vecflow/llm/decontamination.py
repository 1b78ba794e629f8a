"""Benchmark decontamination: spaced-seed hashes of test and training words, verified by substitution-tolerant overlaps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from vecflow.llm.common import kept, lowered_words, sized

MASKS = ("1101011", "1110011", "1011101")  # 1: the word counts, 0: any word may stand there
# Items whose words are too few for the masks, by number of words: with these no overlap of 0.8 is missed up to 22 words.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "11001", "1111"), 6: ("1111", "110011"), 7: ("11011",), 10: ("11011",), 15: ("11011",)}
MIN_RUN = 10
SIMILARITY = 0.8


def hashed(df: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """(name, h): the hashes of the words in order."""
    split = df.select(F.col(id).alias(name), lowered_words(F.col(text)).alias("w"))
    return split.select(name, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def masks_of(words: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """The masks of an item of so many words."""
    return (masks if words >= len(masks[0]) else ()) + SHORT_MASKS.get(words, ())


def seeds(rows: DataFrame, masks: list[str], *columns: str) -> DataFrame:
    """(columns, pos, x0, x1, ...): the words from each place on where the shortest mask fits; null beyond the row's end."""
    span, least = max(map(len, masks)), min(map(len, masks))
    shifted = [F.expr(f"slice(h, {k + 1}, size(h))").alias(f"x{k}") for k in range(span)]
    placed = rows.where(F.size("h") >= least).select(*columns, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "x"))
    return placed.select(*columns, "pos", "x.*").where(f"x{least - 1} IS NOT NULL")


def keys(masks: list[str], within: dict[str, Column] | None = None) -> Column:
    """(mask, key) per mask that fits and whose condition holds: the hash of the places that count."""
    least, made = min(map(len, masks)), []
    for i, m in enumerate(masks):
        key = F.struct(F.lit(i).alias("mask"), F.xxhash64(*(f"x{k}" for k, bit in enumerate(m) if bit == "1")).alias("key"))
        tests = ([F.col(f"x{len(m) - 1}").isNotNull()] if len(m) > least else []) + ([within[m]] if within else [])
        made.append(F.when(reduce(and_, tests), key) if tests else key)
    return F.inline(F.array_compact(F.array(*made)))


def best_run(equal: Column) -> Column:
    """The largest score of a stretch where an equal word counts 1 and another one takes 4: a share of 0.8 scores 0."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0), a["now"] + F.when(x, 1).otherwise(-4))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(equal, start, step, lambda a: a["best"])


def overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_run: int = MIN_RUN,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, start, words, matched, run): where a document holds an item, words possibly substituted.

    A hit of any mask gives the diagonal (place in the document less place in the item). Along it the item is laid on the
    document: ``matched`` of its ``words`` are equal. The overlap counts if that is the share ``similarity`` of all the item's
    words, or if a stretch scores ``min_run`` (each equal word 1, each other -4). The best overlap of each document and
    item is given, ties the first. Words are runs of letters, digits and non-ASCII characters, lower-cased; null texts are
    empty; items without words and rows without an id never match; repeated rows match together. Items too short for
    the masks have masks of their own (``SHORT_MASKS``), so that an item of up to four words matches where its words stand
    and a longer one also with substitutions; only those of lengths that occur are looked for. Benchmark tables are broadcast
    up to a measured size and joined by shuffles beyond it. Texts are shuffled only beyond that size of matching documents.
    An empty table on either side gives no rows.
    """
    if len({len(m) for m in masks}) != 1 or any(m[0] != "1" or m[-1] != "1" for m in masks):
        raise ValueError("masks have one length and count their first and last word")
    docs = hashed(df.where(F.col(id).isNotNull()), id, text, "doc")
    items = kept(hashed(benchmark.where(F.col(item).isNotNull()), item, item_text, "item").distinct())
    short = [r["words"] for r in items.select(F.size("h").alias("words")).where(F.col("words").isin(*SHORT_MASKS)).distinct().collect()]
    used = list(dict.fromkeys([*masks, *(m for n in sorted(short) for m in SHORT_MASKS[n])]))
    lengths = {m: [n for n in short if m in SHORT_MASKS[n]] for m in used}
    within = {m: F.col("words").isin(*lengths[m]) | (F.lit(m in masks) & (F.col("words") >= len(masks[0]))) for m in used}
    placed = seeds(items.withColumn("words", F.size("h")), used, "item", "words")
    planted = kept(placed.select("item", F.col("pos").alias("item_pos"), "x0", keys(used, within)))
    count = planted.count()
    firsts = kept(planted.select("x0").distinct())
    near = seeds(docs, used, "doc").join(sized(firsts, count), "x0", "left_semi")
    hits = near.select("doc", "pos", keys(used)).join(sized(planted.drop("x0"), count), ["mask", "key"])
    lines = hits.select("doc", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    lines = kept(lines)
    some = kept(lines.select("doc").distinct())
    found = docs.join(sized(some, some.count()), "doc", "left_semi")
    laid = lines.join(sized(items.withColumnRenamed("h", "t"), items.count()), "item").join(found, "doc")
    low, back = F.greatest(F.col("diagonal"), F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    length = F.greatest(F.least(F.size("h") - low, F.size("t") - back), F.lit(0))
    laid = laid.select("doc", "item", low.alias("start"), F.size("t").alias("words"), F.slice("h", low + 1, length).alias("h"), F.slice("t", back + 1, length).alias("t"))
    laid = laid.withColumn("equal", F.zip_with("h", "t", lambda x, y: x == y))
    laid = laid.select("doc", "item", "start", "words", F.size(F.filter("equal", lambda e: e)).alias("matched"), best_run(F.col("equal")).alias("run"))
    laid = laid.where((F.col("matched") >= similarity * F.col("words") - 1e-9) | (F.col("run") >= min_run))
    best = laid.groupBy("doc", "item").agg(F.max(F.struct("matched", "run", (-F.col("start")).alias("back"), "words")).alias("b"))
    return best.select(F.col("doc").alias(id), F.col("item").alias(item), (-F.col("b.back")).alias("start"), "b.words", "b.matched", "b.run")


def report(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", item: str = "item_id", **options) -> DataFrame:
    """Per row of the documents: whether it holds a benchmark item, which, and the closest overlap.

    Every row is returned, repeated ones each; a row without an id or text holds none.
    """
    found = overlaps(df, benchmark, id=id, item=item, **options)
    share = F.col("matched") / F.col("words")
    per = found.groupBy(id).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"), F.max("matched").alias("matched"), F.max(share).alias("share"))
    per = kept(per)
    rows = df.select(id).join(sized(per, per.count()), id, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(id, F.col("n_items").isNotNull().alias("leaked"), number("n_items"), F.coalesce("items", F.lit("")).alias("items"), number("matched"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The rows, in their own columns, of documents without an overlap; those without an id or text stay."""
    gone = kept(overlaps(df, benchmark, id=id, **options).select(id).distinct())
    return df.join(sized(gone, gone.count()), id, "left_anti").select(*(f"`{c}`" for c in df.columns))
