"""Document fingerprints: SimHash by packed bit votes, and all pairs within a Hamming radius by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.llm.common import lowered_words, sized, stored

BITS = 64
BUCKET_ROWS = 2_000
MAX_BUCKETS = 100_000
RADIUS = 3
BLOCKS = 6
LOW = 0xFFFFFFFF


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint) of each row; the keys must be unique.

    Terms are a word and the next one (the last word alone); a term weighs its number of characters, 16 at most, each
    time it occurs. Bits k and k + 32 of a term's hash vote in the two halves of one sum, so 32 sums hold all 64 votes;
    a half overflows at 268 million terms. A text without words has fingerprint 0.
    """
    split = texts.select(*keys, lowered_words(F.col(text)).alias("w"))
    pairs = split.select(*keys, F.inline_outer(F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("y"))).alias("x", "y"))
    weight = F.least(F.char_length("x") + F.coalesce(F.char_length("y"), F.lit(0)), F.lit(16)).cast("long")
    terms = pairs.select(*keys, F.xxhash64("x", "y").alias("h"), F.coalesce(weight, F.lit(0).cast("long")).alias("weight"))
    both = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(both) * F.col("weight")).alias(f"v{k}") for k in range(32)]
    counted = terms.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)
    halves = [F.col(f"v{k}").bitwiseAND(F.lit(LOW)) for k in range(32)] + [F.shiftrightunsigned(f"v{k}", 32) for k in range(32)]
    bits = F.concat(*(F.when(2 * half > F.col("total"), "1").otherwise("0") for half in reversed(halves)))
    return counted.select(*keys, number(bits).alias("fingerprint"))


def number(bits: Column) -> Column:
    """64 binary digits as a signed long."""
    part = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(33))


def written(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(x.bitwiseXOR(y)) / F.lit(float(BITS))


def in_order(df: DataFrame, id: str, text: str) -> DataFrame:
    """(bucket, place, id, text, next_text, shown): each document with the text after it, by descending id.

    Ids are cut into buckets at existing ids, so that the row at a cut is known by itself: it is copied to the bucket
    below, whose first row follows it. The first document of all is copied behind the last. Rows that are there only to
    be followed or to follow are not ``shown``. Null ids come last; ties are ordered by text. One shuffle of the texts.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count, top = rows.agg(F.count("*"), F.max("id")).first()
    buckets = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    ranged = rows.where("id IS NOT NULL").select("id").repartitionByRange(buckets, "id").withColumn("part", F.spark_partition_id())
    cuts = sorted(r["low"] for r in ranged.groupBy("part").agg(F.min("id").alias("low")).collect()) or [-(2**63)]  # one per bucket
    step = max(1, int(len(cuts) ** 0.5))
    heads = F.array(*(F.lit(c).cast("long") for c in cuts[::step]))
    tails = F.array(*(F.array(*(F.lit(c).cast("long") for c in cuts[i : i + step])) for i in range(0, len(cuts), step)))
    below = lambda cuts_, x: F.size(F.filter(cuts_, lambda c: c <= x))
    coarse = F.greatest(below(heads, F.col("id")), F.lit(1))
    rows = rows.withColumn("k", F.when(F.col("id").isNull(), 1).otherwise(coarse)).withColumn("near", F.element_at(tails, F.col("k")))
    rows = rows.withColumn("pos", F.when(F.col("id").isNull(), 1).otherwise(F.greatest(below(F.col("near"), F.col("id")), F.lit(1))))
    bucket = (F.col("k") - 1) * step + F.col("pos") - 1
    at = lambda b, head, tail: F.struct(b.cast("int").alias("bucket"), F.lit(head).alias("head"), F.lit(tail).alias("tail"))
    nothing = F.array().cast("array<struct<bucket:int,head:boolean,tail:boolean>>")
    places = F.concat(
        F.array(at(bucket, False, False)),
        F.when((F.element_at("near", F.col("pos")) == F.col("id")) & (bucket > 0), F.array(at(bucket - 1, True, False))).otherwise(nothing),
        F.when(F.col("id").eqNullSafe(F.lit(top).cast("long")), F.array(at(F.lit(0), False, True))).otherwise(nothing),
    )
    dealt = rows.select("id", "text", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("tail", F.desc_nulls_last("id"), "text")
    placed = dealt.select(
        "bucket",
        F.row_number().over(order).alias("place"),
        "id",
        "text",
        F.lead("text").over(order).alias("next_text"),
        F.lead("head").over(order).alias("next_head"),
        "head",
        "tail",
    )
    shown = F.col("next_text").isNotNull() & ~F.col("tail") & ~(F.col("head") & F.col("next_head"))
    return placed.select("bucket", "place", "id", "text", "next_text", shown.alias("shown"))


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) per row, stored.

    The edited text has its last third (floor of code points / 3) replaced by the first as many code points, or all, of the
    next document by descending id; the first document follows the last. A null text is empty; a row without an id comes
    last; repeated rows each give a row and follow each other; no rows give no rows; other columns are not read. Votes,
    neighbours and fingerprints stay in the partitions that the one shuffle of the texts made.
    """
    rows = in_order(df, id, text)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "place", "id", "shown", n.cast("long").alias("n_chars"), "text", F.when(F.col("shown"), edited).alias("edited"))
    keys = ["bucket", "place", "id", "shown", "n_chars", "sha", "kind"]
    both = rows.select("bucket", "place", "id", "shown", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    printed = votes(both.where("text IS NOT NULL"), keys)
    own = F.max(F.when(F.col("kind") == 0, F.col("fingerprint")))
    other = F.max(F.when(F.col("kind") == 1, F.col("fingerprint")))
    whole = printed.groupBy(*keys[:-1]).agg(own.alias("fingerprint"), other.alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    out = whole.select("id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", following.alias("next_fingerprint"), "shown")
    return stored(out.where("shown").drop("shown"), "fingerprints").withColumnRenamed("id", id)


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints at most ``radius`` bits apart.

    The bits are cut into ``blocks``; two such fingerprints agree on at least ``blocks - radius`` of them, so each choice of
    that many blocks is a table whose rows join on the chosen bits. A pair is taken from the first of its tables only.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]
    distinct = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    tables = F.transform(F.array(*map(F.lit, chosen)), lambda m, i: F.struct(i.alias("table"), F.col("fingerprint").bitwiseAND(m).alias("key")))
    rows = distinct.select("fingerprint", F.inline(tables))
    x, y = rows.withColumnRenamed("fingerprint", "a"), rows.withColumnRenamed("fingerprint", "b")
    off = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(F.array(*map(F.lit, chosen)), lambda m: off.bitwiseAND(m) == 0), True) - 1
    joined = x.join(y, (x["table"] == y["table"]) & (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(off) <= radius))
    return joined.where(first == x["table"]).select("a", "b")


def report(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints as text, their likeness to the edited and the next text's, and the number of other fingerprints near."""
    prints = fingerprints(df, id, text)
    pairs = near_pairs(prints, radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint"))
    near = stored(ends.groupBy("fingerprint").agg(F.count("*").alias("n_near")), "near")
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return prints.join(sized(near, near.count()), "fingerprint", "left").select(
        id,
        "n_chars",
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
