"""Votes over neighbour lists ``(query_id, rank, neighbor_id, distance, label)``.

The lists come hash-partitioned by query from the final top-k; grouping by query and
label keeps that partitioning, so a vote adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecflow.operators.neighbors import exact_topk

EPSILON = 1e-6
VOTES = ("uniform", "distance")
QUERY = ("query_id",)


def _best(tally: DataFrame, *order: Column, keys: Sequence[str] = QUERY, keep: Sequence[Column] = ()) -> DataFrame:
    """Per query the label that comes first in the given order, the smallest one on a tie."""
    key = F.struct(*order, F.col("label"))
    return tally.groupBy(*keys).agg(F.min_by("label", key).alias("prediction"), *keep)


def majority(hits: DataFrame, keys: Sequence[str] = QUERY) -> DataFrame:
    """Most frequent label, the smallest one on a tie, with its share of the votes."""
    tally = hits.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("votes"))
    share = (F.max("votes") / F.sum("votes")).alias("score")
    return _best(tally, -F.col("votes"), keys=keys, keep=[share])


def vote_weight(distance: Column, mode: str = "distance", exact_matches: Column | None = None) -> Column:
    """Weight of one neighbour.

    ``distance``: 1/(d + 1e-6). ``raw_score``: the same over the similarity 1 - d.
    ``inverse``: 1/d, where rows at distance 0 take all the weight.
    """
    if mode == "distance":
        return F.try_divide(F.lit(1.0), distance + EPSILON)
    if mode == "raw_score":
        return F.try_divide(F.lit(1.0), (1.0 - distance) + EPSILON)
    if mode == "inverse":
        return F.when(exact_matches > 0, (distance == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), distance))
    raise ValueError(f"unknown weight mode {mode!r}")


def weighted(hits: DataFrame, mode: str = "distance", keys: Sequence[str] = QUERY) -> DataFrame:
    """Label with the greatest total weight (compared to 6 digits), the smallest one on a tie."""
    exact = None
    if mode == "inverse":
        zero = hits.groupBy(*keys).agg(F.count_if(F.col("distance") == 0).alias("exact_matches"))
        hits = hits.join(zero, list(keys))
        exact = F.col("exact_matches")
    tally = hits.groupBy(*keys, "label").agg(F.sum(vote_weight(F.col("distance"), mode, exact)).alias("weight"))
    return _best(tally.withColumn("weight", F.round("weight", 6)), -F.col("weight"), keys=keys)


def predict(hits: DataFrame, vote: str = "uniform") -> DataFrame:
    if vote == "uniform":
        return majority(hits).select("query_id", "prediction")
    if vote == "distance":
        return weighted(hits)
    raise ValueError(f"unknown vote {vote!r}, expected one of {VOTES}")


def configured(hits: DataFrame, keys: Sequence[str], vote: Column) -> DataFrame:
    """Votes of many configurations in one pass; ``vote`` names the kind of each row's vote."""
    weight = F.when(vote == "uniform", F.lit(1.0)).when(vote == "distance", vote_weight(F.col("distance"))).otherwise(
        F.raise_error(F.lit("unknown vote"))
    )
    tally = hits.groupBy(*keys, "label").agg(F.round(F.sum(weight), 6).alias("weight"))
    return _best(tally, -F.col("weight"), keys=keys)


def reciprocal_rank(hits: DataFrame) -> DataFrame:
    """Sum of 1/rank per label; on a tie the label met first."""
    tally = hits.groupBy("query_id", "label").agg(
        F.round(F.sum(1.0 / F.col("rank")), 9).alias("score"), F.min("rank").alias("first_rank")
    )
    return _best(tally, -F.col("score"), F.col("first_rank"), keep=[F.max("score").alias("score")])


def validity(train: DataFrame, k: int, metric: str = "cosine", search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """For each train row the share of its k nearest other rows that carry its label.

    ``search`` gives the hits of queries in an index over the same rows; without it the search is exact.
    """
    if search is None:
        hits = exact_topk(train, train, k, metric, skip_same=True)
    else:  # one more hit, as a row finds itself
        hits = search(train, k + 1).where(F.col("query_id") != F.col("neighbor_id"))
        order = Window.partitionBy("query_id").orderBy("rank")
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = train.select(F.col("id").alias("query_id"), F.col("label").alias("own_label"))
    same = F.count_if(F.col("label") == F.col("own_label")) / F.lit(k)
    return hits.join(own, "query_id").groupBy("query_id").agg(same.alias("validity")).withColumnRenamed("query_id", "id")


def with_validity(hits: DataFrame, scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Majority among neighbours of validity >= threshold, among all where none is.

    On a tie the label whose neighbour is nearest wins.
    """
    scored = hits.join(scores.select(F.col("id").alias("neighbor_id"), "validity"), "neighbor_id", "left")
    valid = F.coalesce(F.col("validity") >= threshold, F.lit(False))
    tally = scored.groupBy("query_id", "label").agg(
        F.count_if(valid).alias("valid_votes"),
        F.min(F.when(valid, F.col("rank"))).alias("valid_rank"),
        F.count(F.lit(1)).alias("votes"),
        F.min("rank").alias("first_rank"),
    )
    # a label with valid votes comes before any without, so the last two only matter when none has any
    order = [
        -F.col("valid_votes"),
        F.coalesce("valid_rank", F.lit(0)),
        F.when(F.col("valid_votes") > 0, F.lit(0)).otherwise(-F.col("votes")),
        F.col("first_rank"),
    ]
    return _best(tally, *order, keep=[F.sum("valid_votes").alias("valid_neighbors")])


def one_vs_rest(hits: DataFrame, k: int) -> DataFrame:
    """One yes/no vote per class; yes needs more than half of the k neighbours.

    One yes: that class. Several: the class with the smallest mean neighbour distance.
    None: the class with most yes votes. Remaining ties go to the smallest class.
    """
    tally = hits.groupBy("query_id", "label").agg(
        F.count(F.lit(1)).alias("votes"), F.round(F.avg("distance"), 9).alias("mean_distance")
    )
    yes = F.col("votes") * 2 > k
    order = [
        F.when(yes, F.lit(0)).otherwise(F.lit(1)),
        F.when(yes, F.col("mean_distance")).otherwise(-F.col("votes").cast("double")),
    ]
    return _best(tally, *order, keep=[F.count_if(yes).alias("yes_classes")])
