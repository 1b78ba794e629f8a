"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"{k}__right" for k in keys])
