"""Grids over data axes: segment, overlap, feature, reduction, split and folds as well as search parameters.

A grid row is a plan of keyed stages: features -> reduction -> split -> scaler -> index -> search -> vote. Rows that agree up
to a stage share its stored result; a stage that fails skips its rows with the message, and the others go on.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecflow.operators import splits
from vecflow.operators.reduction import reduce_matrix
from vecflow.plans.experiments import GRID_KEYS, configuration_of, run_folds, run_grid, train_and_test
from vecflow.session import shared_dir

DATA_KEYS = ("segment", "overlap", "feature")
SPLIT_KEYS = ("balanced", "folds", "split_seed")
DEFAULTS = {"segment": 0, "overlap": 0, "operation": "mean", "balanced": False, "folds": 0, "split_seed": 42}
SCHEMA = "row_key string, fold int, accuracy double, testing_set_size bigint, training_set_size bigint, message string"


def search_parameters(text: str | None) -> dict:
    """Search parameters of an ``index_params`` text: a literal with ``params`` (the index), ``nprobe`` and ``neighbors``."""
    if not text:
        return {}
    try:
        found = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        raise ValueError(f"index parameters that are no literal: {text!r}") from None
    names = {"params": "index", "nprobe": "nprobe", "neighbors": "neighbors", "nbits": "nbits"}
    if not isinstance(found, dict) or (unknown := set(found) - set(names)):
        raise ValueError(f"unknown index parameters {sorted(unknown) if isinstance(found, dict) else text!r}")
    return {names[k]: v for k, v in found.items()}


def staged(configurations: Sequence[dict]) -> tuple[dict, list[tuple[str, str]]]:
    """data -> reduction -> split -> rows, and the rows that can't be run with the reason; an unknown key is an error."""
    known = GRID_KEYS | set(DATA_KEYS) | set(SPLIT_KEYS) | {"operation", "index_params"}
    tree: dict[tuple, dict[str, dict[tuple, list[dict]]]] = {}
    skipped = []
    for row in configurations:
        if unknown := set(row) - known:
            raise ValueError(f"unknown keys {sorted(unknown)}, expected {sorted(known)}")
        axes = {**DEFAULTS, **row}
        try:
            own = {k: v for k, v in row.items() if k in GRID_KEYS}
            member = configuration_of({**own, **search_parameters(row.get("index_params"))})
        except ValueError as error:
            skipped.append((row["row_key"], str(error)))
            continue
        data, split = (tuple(axes[k] for k in keys) for keys in (DATA_KEYS, SPLIT_KEYS))
        tree.setdefault(data, {}).setdefault(axes["operation"], {}).setdefault(split, []).append(member)
    return tree, skipped


def message(error: Exception) -> str:
    return next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)


def _folded(rows: DataFrame, members: Sequence[dict], folds: int, seed: int, skipped: list) -> list[DataFrame]:
    out = []
    for c in members:
        try:
            options = {k: c[k] for k in ("metric", "normalize", "index", "nprobe", "nbits")}
            found = run_folds(rows, "id", "vector", "label", "grp", folds, k=c["neighbors"], vote=c["vote_type"], seed=seed, **options)
            out.append(found.select(F.lit(c["row_key"]).alias("row_key"), F.col("fold").cast("int"), "accuracy", "testing_set_size", "training_set_size", F.lit(None).cast("string").alias("message")).checkpoint())
        except (ValueError, PySparkException) as error:
            skipped.append((c["row_key"], message(error)))
    return out


def _held_out(rows: DataFrame, members: Sequence[dict], balanced: bool, seed: int) -> DataFrame:
    """One split; its rows share scalers, indexes and searches."""
    split = splits.balanced_holdout if balanced else splits.holdout
    flagged = split(rows, "label", "grp", seed, flag="in_train").checkpoint()
    train, test = train_and_test(flagged, "id", "vector", "label", "in_train")
    own = [{k: v for k, v in c.items() if k in GRID_KEYS} for c in members]
    found = run_grid(train, test, own)
    return found.select("row_key", F.lit(None).cast("int").alias("fold"), "accuracy", F.col("n").alias("testing_set_size"), "training_set_size", "message")


def run_data_grid(load: Callable[[dict], DataFrame], configurations: Sequence[dict]) -> DataFrame:
    """One row per configuration, one per fold with ``folds``: accuracy and sizes; ``skipped`` with a message where it failed.

    ``load`` gives the rows ``(id, matrix, label, grp)`` (matrix: values x frames) of ``segment``, ``overlap`` and
    ``feature``, and is asked once for each. A configuration has ``row_key, feature, metric, neighbors, vote_type`` and perhaps
    ``segment, overlap, operation, balanced, folds, split_seed, index_params`` and the keys of ``run_grid``. Each reduction and
    split is stored once; the loops are over the few stages and only start jobs.
    """
    tree, skipped = staged(configurations)
    results: list[DataFrame] = []
    session = None
    for data, reductions in tree.items():
        everything = [c for by_split in reductions.values() for members in by_split.values() for c in members]
        try:
            source = load(dict(zip(DATA_KEYS, data)))
        except (ValueError, PySparkException) as error:
            skipped += [(c["row_key"], message(error)) for c in everything]
            continue
        session = source.sparkSession
        shared_dir(session)
        for operation, by_split in reductions.items():
            try:
                rows = source.select("id", reduce_matrix(F.col("matrix"), operation).alias("vector"), "label", "grp").checkpoint()
            except (ValueError, PySparkException) as error:
                skipped += [(c["row_key"], message(error)) for members in by_split.values() for c in members]
                continue
            for (balanced, folds, seed), members in by_split.items():
                if folds:
                    results += _folded(rows, members, folds, seed, skipped)
                    continue
                try:
                    results.append(_held_out(rows, members, balanced, seed))
                except (ValueError, PySparkException) as error:
                    skipped += [(c["row_key"], message(error)) for c in members]
    session = session or SparkSession.getActiveSession()
    table = session.createDataFrame([(k, None, None, None, None, m) for k, m in skipped], SCHEMA)
    for other in results:
        table = table.unionByName(other)
    return table.withColumn("skipped", F.col("message").isNotNull())
