"""Mixing sources to target weights: water-filled targets, certain whole copies, Pareto order sampling for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.llm.common import kept, sized, stored, uniform

MAX_COPIES = 2
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CELL_ROWS = 5_000
FILLS = 2
NOISE = 1e-9


def words(text: Column) -> Column:
    """Number of runs of other characters than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key(source: Column) -> Column:
    """A text that orders and joins like the source, null included and last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def appeal(size: Column) -> Column:
    """Relative number of expected copies: longer documents are favoured a little, in steps of powers of two."""
    return 1 + F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) / 8.0


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds the 0-based ``position`` in the order of ``by``; only one row per partition meets in one task."""
    rows = kept(df.sort(by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("at"), 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    joined = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("position", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...]) -> tuple[DataFrame, int]:
    """(key, source_size, target) per source of (key, size), and the number of sources.

    Sources in order of their key weigh ``weights`` in turn. A target stops at twice its source's size and the excess
    is shared again by weight among the others until none is above: each round is an aggregate of the source table,
    in which the words per weight only grow.
    """
    sources = numbered(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    table = kept(sources.select("key", "source_size", weight.alias("weight"), (MAX_COPIES * F.col("source_size")).cast("double").alias("cap")))
    number, everything = table.agg(F.count("*"), F.sum("source_size")).first()
    level, before = 0.0, -1
    while number:
        full = F.col("cap") <= F.col("weight") * level
        row = table.agg(
            F.sum(full.cast("long")).alias("n"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("filled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before, level = row["n"], max(level, (share * everything - row["filled"]) / row["open"])
    return table.select("key", "source_size", F.least("cap", F.col("weight") * level).alias("target")), number


def plan(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> tuple[DataFrame, int]:
    """What decides on every document of (id, key, size), one row per source, and the number of sources.

    Expected copies of a document are min(2, scale * appeal), with the scale that gives the source its target. The whole
    part is certain. For the fraction p, documents are ranked by Pareto's u/(1-u) : p/(1-p), of which z = q/(1+q) is
    a form within (0, 1); they are taken in that order while the words still needed allow. Then, ``FILLS`` times, the
    largest document that fits into what is missing is added, and at last the one of the nearest size, if that brings
    the source nearer to its target.
    """
    goals, number = targets(sizes, share, weights)
    steps = sizes.groupBy("key", appeal(F.col("size")).alias("appeal")).agg(F.sum("size").alias("words"))
    down = Window.partitionBy("key").orderBy(F.desc("appeal"))  # at most 64 rows per source
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("appeal")).over(down.rowsBetween(0, Window.unboundedFollowing))
    filled = steps.join(sized(goals, number), "key").withColumn("scale", F.when(rest > 0, (F.col("target") - MAX_COPIES * above) / rest))
    fits = F.col("scale") * F.col("appeal") <= MAX_COPIES * (1 + NOISE)
    scales = filled.groupBy("key").agg(F.max_by(F.when(fits, F.col("scale")), F.when(fits, F.col("appeal"))).alias("scale"))
    goals = kept(goals.join(scales, "key").withColumn("scale", F.coalesce("scale", F.lit(0.0))))

    drawn = sizes.join(sized(goals, number), "key").withColumns(draw(F.col("id"), F.col("size"), seed))
    rows = sizes.count()
    cells = max(16, 8 * (rows // CELL_ROWS))
    drawn = drawn.withColumn("cell", F.least(F.floor(F.col("z") * cells), F.lit(cells - 1)))
    certain = drawn.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = kept(goals.join(certain, "key").withColumn("need", F.col("target") - F.col("certain")))

    open_ = drawn.where("p > 0")
    cumulated = Window.partitionBy("key").orderBy("cell")
    sums = open_.groupBy("key", "cell").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(cumulated)).join(sized(need.select("key", "need"), number), "key")
    border = upto.where("upto > need").groupBy("key").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("b"))
    border = need.join(border, "key", "left").select("key", "need", "b.cell", F.coalesce("b.before", F.lit(0)).alias("before"))
    border = kept(border)
    # a cell holds about CELL_ROWS / 8 documents; those with equal z and id are taken together
    inside = open_.join(sized(border.withColumnRenamed("cell", "cut"), number), "key").where("cell = cut")
    running = F.sum("size").over(Window.partitionBy("key").orderBy("z", "id").rangeBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("running", F.col("before") + running).where("running <= need")
    last = inside.groupBy("key").agg(F.max(F.struct("z", "id", "running")).alias("last"))
    cut = border.join(last, "key", "left").select(
        "key",
        F.coalesce("last.z", F.when(F.col("cell").isNull(), 1.0).otherwise(F.col("cell") / cells)).alias("last_z"),
        F.coalesce("last.id", F.lit(-(2**63))).alias("last_id"),
        F.col("last.running").alias("running"),
        "before",
        "need",
        "cell",
    )
    everything = open_.groupBy("key").agg(F.sum("size").alias("open"))
    cut = cut.join(everything, "key", "left").withColumn(
        "missing", F.col("need") - F.coalesce("running", F.when(F.col("cell").isNull(), F.coalesce("open", F.lit(0))).otherwise(F.col("before")))
    )
    cut = kept(cut.select("key", "last_z", "last_id", "missing", F.array().cast("array<long>").alias("extra")))
    for nearest in (False,) * FILLS + (True,):
        off = F.abs(F.col("missing") - F.col("size"))
        left = open_.join(sized(cut, number), "key").where(~picked() & ~F.array_contains("extra", F.col("id")) & (F.col("size") > 0))
        left = left.where(off < F.col("missing") if nearest else F.col("size") <= F.col("missing"))
        chosen = left.groupBy("key").agg(F.min(F.struct(off.alias("off"), "z", "id", "size")).alias("e"))
        cut = cut.join(chosen, "key", "left").select(
            "key",
            "last_z",
            "last_id",
            (F.col("missing") - F.coalesce("e.size", F.lit(0))).alias("missing"),
            F.when(F.col("e.id").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("e.id"))).alias("extra"),
        )
        cut = kept(cut)
    out = goals.join(cut, "key").select("key", "source_size", "target", "scale", "last_z", "last_id", "extra")
    return kept(out), number


def draw(id: Column, size: Column, seed: int) -> dict[str, Column]:
    """Certain copies, fraction and Pareto rank of a row that holds its source's scale."""
    expected = F.least(F.lit(float(MAX_COPIES)), F.col("scale") * appeal(size))
    whole = F.floor(expected + NOISE)
    p = F.greatest(expected - whole, F.lit(0.0))
    p = F.when(p > NOISE, p).otherwise(0.0)
    u = uniform(seed, id)
    return {"whole": whole, "p": p, "z": u * (1 - p) / (u * (1 - p) + (1 - u) * p)}


def picked() -> Column:
    return (F.col("p") > 0) & ((F.col("z") < F.col("last_z")) | ((F.col("z") == F.col("last_z")) & (F.col("id") <= F.col("last_id"))))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """All rows with size, source_size, target and copies (0, 1 or 2) as the struct column ``mixed``.

    The decision on a row needs only the row and its source's line of the plan, so texts are never shuffled. A null text
    has size 0 and no copies; null sources are one source, the last; repeated rows (id and text)
    are taken or left together; rows without an id draw by their text; no rows give no rows. Reruns agree: the random number
    is a hash of seed, id and text.
    """
    number = F.xxhash64(F.col(id), F.col(text))
    sizes = stored(df.select(number.alias("id"), key(F.col(source)).alias("key"), words(F.col(text)).alias("size")), "sizes")
    decided, sources = plan(sizes, share, weights, seed)
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), number.alias("id"), key(F.col(source)).alias("key"), words(F.col(text)).alias("size"))
    return _copies(row.join(sized(decided, sources), "key"), seed)


def _copies(rows: DataFrame, seed: int) -> DataFrame:
    rows = rows.withColumns(draw(F.col("id"), F.col("size"), seed))
    more = picked() | (F.array_contains("extra", F.col("id")) & (F.col("p") > 0))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0)
    return rows.withColumn("mixed", F.struct("size", "source_size", "target", copies.alias("copies")))


def report(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    number = F.xxhash64(F.col(id), F.col(text))
    sizes = stored(df.select(F.col(id).alias("own"), number.alias("id"), key(F.col(source)).alias("key"), words(F.col(text)).alias("size")), "sizes")
    decided, sources = plan(sizes.drop("own"), share, weights, seed)
    rows = _copies(sizes.join(sized(decided, sources), "key"), seed)
    return rows.select(F.col("own").alias(id), "size", "source_size", "target", (F.col("mixed.copies") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in its own columns."""
    rows = mix(df, **options).where("mixed.copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mixed.copies").cast("int")))).select("row.*")
