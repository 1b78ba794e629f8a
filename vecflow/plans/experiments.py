"""Whole experiments: split, scale, search, vote, evaluate - one configuration, folds or a grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from vecflow.functions.vectors import doubles, metric_name
from vecflow.operators import evaluation, indexes, splits, votes
from vecflow.operators.folds import masked_topk
from vecflow.operators.neighbors import as_vectors, exact_topk
from vecflow.operators.ranking import first_valid_by_key
from vecflow.operators.scaling import apply_minmax, fit_minmax, fold_scalers
from vecflow.plans.measure import measured
from vecflow.session import shared_dir


def train_and_test(
    df: DataFrame, id: str, vector: str, label: str, flag: str = "train1"
) -> tuple[DataFrame, DataFrame]:
    """The two sides of a flagged table in search form."""
    return (
        as_vectors(df.where(F.col(flag) == 1), id, vector, label),
        as_vectors(df.where(F.col(flag) == 0), id, vector, label),
    )


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides min-max scaled with the extremes of the train side.

    The one-row scaler is checkpointed: several jobs read it, the train rows are scanned once.
    """
    shared_dir(train.sparkSession)
    scaler = fit_minmax(train, "vector").checkpoint()
    return apply_minmax(train, scaler), apply_minmax(test, scaler)


def with_truth(predictions: DataFrame, test: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Predictions with the true label; a query without hits keeps its row if the predictions are of one configuration."""
    truth = test.select(F.col("id").alias("query_id"), F.col("label").alias("y"))
    how = "inner" if keys else "right"
    return predictions.join(truth, "query_id", how).select(*keys, "query_id", "y", F.col("prediction").alias("y_hat"))


def classify(
    train: DataFrame,
    test: DataFrame,
    metric: str = "cosine",
    k: int = 15,
    vote: str = "uniform",
    normalize: bool = True,
    index: str = "Flat",
    **options,
) -> DataFrame:
    """Predictions ``(query_id, y, y_hat)`` of one configuration.

    ``index`` names the search (``Flat`` is exact); options are split between building
    (``nbits, seed``) and searching (``nprobe``).
    """
    if normalize:
        train, test = scaled(train, test)
    if index == "Flat":
        hits = exact_topk(test, train, k, metric)
    else:
        build = {n: v for n, v in options.items() if n in ("nbits", "seed")}
        search = {n: v for n, v in options.items() if n == "nprobe"}
        if unknown := set(options) - set(build) - set(search):
            raise ValueError(f"unknown options {sorted(unknown)}")
        hits = indexes.search_index(indexes.build_index(train, index, metric, **build), test, k, **search)
    return with_truth(votes.predict(hits, vote), test)


def run_configuration(train: DataFrame, test: DataFrame, classes: Sequence[int], row_key: str, **configuration) -> DataFrame:
    """The result row of one configuration."""
    result = evaluation.flat_result(classify(train, test, **configuration), "y", "y_hat", classes)
    return result.withColumns({"training_set_size": F.lit(train.count()), "row_key": F.lit(row_key)})


GRID_KEYS = {"row_key", "metric", "neighbors", "vote_type", "normalize", "index", "nprobe", "nbits", "seed"}
RESULT_SCHEMA = (
    "row_key string, accuracy double, n bigint, training_set_size bigint, train_seconds double, predict_seconds double, message string"
)


def configuration_of(row: dict) -> dict:
    """A grid row with defaults; raises ``ValueError`` for what can't be run."""
    c = {"normalize": True, "index": "Flat", "nprobe": 1, "nbits": 8, "seed": 42, **row}
    c["metric"] = metric_name(c["metric"])
    if c["vote_type"] not in votes.VOTES:
        raise ValueError(f"unknown vote {c['vote_type']!r}, expected one of {votes.VOTES}")
    if c["neighbors"] < 1 or c["nprobe"] < 1:
        raise ValueError("neighbors and nprobe must be at least 1")
    indexes.parse_spec(c["index"])
    return c


@dataclass
class Search:
    """What one search gave: the counted predictions ``(row_key, y, y_hat, n)`` of the configurations it serves, and its numbers."""

    members: list[dict]
    pairs: DataFrame
    numbers: dict


def run_searches(train: DataFrame, test: DataFrame, configurations: Sequence[dict]) -> tuple[list[Search], list[tuple[str, str]]]:
    """All searches of a grid, and (row key, message) of the rows that can't be run; an unknown key is an error.

    Each distinct index is built once; the configurations that share it and the number of probes share one search with their
    largest k, whose hits a rank filter and one vote pass turn into all their predictions. The loops are over the few
    builds and searches, not over the configurations; only counted predictions are stored.
    """
    spark = train.sparkSession
    shared_dir(spark)
    for row in configurations:
        if unknown := set(row) - GRID_KEYS:
            raise ValueError(f"unknown keys {sorted(unknown)}, expected {sorted(GRID_KEYS)}")
    skipped: list[tuple[str, str]] = []
    builds: dict[tuple, dict[int, list[dict]]] = {}
    for row in configurations:
        try:
            c = configuration_of(row)
        except ValueError as error:
            skipped.append((row["row_key"], str(error)))
            continue
        searches = builds.setdefault((c["metric"], c["normalize"], c["index"], c["nbits"], c["seed"]), {})
        searches.setdefault(c["nprobe"] if "IVF" in c["index"] else 1, []).append(c)
    sides, sizes, results = {False: (train, test)}, {}, []
    for (metric, normalize, index, nbits, seed), searches in builds.items():
        if normalize not in sides:
            sides[normalize] = scaled(train, test)
        left, right = sides[normalize]
        try:
            build = lambda: None if index == "Flat" else indexes.build_index(left, index, metric, nbits=nbits, seed=seed)  # noqa: B023, E731
            built, train_seconds, train_memory = measured(spark, build)
        except ValueError as error:
            skipped += [(c["row_key"], str(error)) for members in searches.values() for c in members]
            continue
        sizes.setdefault("train", left.count())
        for nprobe, members in searches.items():
            most = max(c["neighbors"] for c in members)

            def search():
                hits = exact_topk(right, left, most, metric) if built is None else indexes.search_index(built, right, most, nprobe)  # noqa: B023
                return _served(hits, members, test).checkpoint()  # noqa: B023

            try:
                pairs, seconds, memory = measured(spark, search)
            except (ValueError, PySparkException) as error:  # of these rows only: the other searches go on
                said = next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)
                skipped += [(c["row_key"], said) for c in members]
                continue
            numbers = {
                "training_set_size": sizes["train"], "train_seconds": train_seconds, "predict_seconds": seconds,
                "train_memory": train_memory, "predict_memory": memory,
            }
            results.append(Search(members, pairs, numbers))
    return results, skipped


def run_grid(train: DataFrame, test: DataFrame, configurations: Sequence[dict]) -> DataFrame:
    """A result row per configuration: accuracy, sizes, seconds; ``skipped`` with a message where it can't be run.

    A configuration has ``row_key, metric, neighbors, vote_type`` and perhaps ``normalize, index, nbits, seed, nprobe``; an
    unknown key is an error. ``train_seconds`` are those of the shared build, ``predict_seconds`` of the whole shared search
    (see :func:`run_searches`).
    """
    searches, skipped = run_searches(train, test, configurations)
    table = train.sparkSession.createDataFrame([(k, None, None, None, None, None, m) for k, m in skipped], RESULT_SCHEMA)
    for search in searches:
        found = evaluation.pair_results(search.pairs, ["row_key"], ()).withColumnRenamed("testing_set_size", "n")
        numbers = {k: F.lit(search.numbers[k]) for k in ("training_set_size", "train_seconds", "predict_seconds")}
        table = table.unionByName(found.withColumns(numbers).withColumn("message", F.lit(None).cast("string")))
    return table.withColumn("skipped", F.col("message").isNotNull())


def _served(hits: DataFrame, members: Sequence[dict], test: DataFrame) -> DataFrame:
    """Counted predictions of the configurations that one search serves; a query without hits has a null prediction."""
    listed = F.array(*[
        F.struct(F.lit(c["row_key"]).alias("row_key"), F.lit(int(c["neighbors"])).alias("k"), F.lit(c["vote_type"]).alias("vote_type"))
        for c in members
    ])
    # every hit serves the configurations whose k reaches its rank
    served = hits.withColumn("c", F.explode(F.filter(listed, lambda c: c["k"] >= F.col("rank"))))
    served = served.select("query_id", "label", "distance", F.col("c.row_key").alias("row_key"), F.col("c.vote_type").alias("vote_type"))
    predicted = votes.configured(served, ["row_key", "query_id"], F.col("vote_type"))
    asked = test.select(F.col("id").alias("query_id"), F.col("label").alias("y"), F.explode(F.array(*[F.lit(c["row_key"]) for c in members])).alias("row_key"))
    both = asked.join(predicted, ["row_key", "query_id"], "left")
    return evaluation.counted_pairs(both, "y", "prediction", ["row_key"])


def run_folds(
    df: DataFrame, id: str, vector: str, label: str, group: str, folds: int, k: int = 15, metric: str = "cosine",
    vote: str = "uniform", seed: int = 42, normalize: bool = True, index: str = "Flat", nprobe: int = 1, nbits: int = 8,
) -> DataFrame:
    """Per fold accuracy and sizes; a query without hits is a miss.

    A row is a query in its own fold and a train row in each other one, scaled with the extremes of that fold's train rows.
    The exact search handles all folds at once, with the fold as a mask inside the block, so a vector is stored once.
    With an index each fold builds and searches its own; the loop over the folds only starts jobs.
    """
    shared_dir(df.sparkSession)
    dealt = splits.assign_folds(df, label, group, folds, seed, keep=True)
    rows = dealt.select(
        F.col(id).cast("bigint").alias("id"), doubles(F.col(vector)).alias("vector"),
        F.col(label).cast("int").alias("label"), "fold",
    )
    if index == "Flat":
        rows = rows.checkpoint()
        hits = masked_topk(rows, k, metric, fold_scalers(rows, folds) if normalize else None)
    else:
        hits = _indexed_folds(rows, folds, k, metric, normalize, index, nprobe, nbits, seed)
    truth = rows.select(F.col("id").alias("query_id"), F.col("label").alias("y"), "fold")
    scored = truth.join(votes.predict(hits, vote), "query_id", "left")
    per_fold = evaluation.accuracy(scored, "y", "prediction", ["fold"])
    total = rows.count()
    return per_fold.withColumnRenamed("n", "testing_set_size").withColumn(
        "training_set_size", F.lit(total) - F.col("testing_set_size")
    )


def _indexed_folds(rows, folds, k, metric, normalize, index, nprobe, nbits, seed) -> DataFrame:
    hits = None
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold).drop("fold"), rows.where(F.col("fold") == fold).drop("fold")
        if normalize:
            train, test = scaled(train, test)
        built = indexes.build_index(train, index, metric, nbits=nbits, seed=seed)
        found = indexes.search_index(built, test, k, nprobe)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def distinct_builds(configurations: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One configuration per index build: the first non-null value of each other column."""
    return first_valid_by_key(configurations, keys, order)


def fill_collections(
    configurations: Sequence[dict], load: Callable[[dict], DataFrame], create: Callable[[dict], str],
    insert: Callable[[DataFrame, str], None],
) -> list[str]:
    """Fills one vector table per configuration with its scaled train rows; the loop only starts jobs."""
    names = []
    for configuration in configurations:
        train = load(configuration)
        name = create(configuration)
        insert(apply_minmax(train, fit_minmax(train, "vector")), name)
        names.append(name)
    return names


def repeat_rounds(run: Callable[[int], DataFrame], rounds: int) -> DataFrame:
    """Results of several rounds with their number."""
    tables = [run(r).withColumn("round", F.lit(r)) for r in range(rounds)]
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    return table
