"""Feature matrix (coefficients x frames) to one fixed-length vector.

A matrix is one row of bounded size (a clip has a fixed length), so every reduction is an
expression on the nested array and needs no shuffle. Long measurements per key, which
are not bounded, have their own grouped form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from vecflow.functions.vectors import let, mean, std_pop
from vecflow.functions.joins import null_safe_join
from vecflow.operators.ranking import ROWS_PER_RANGE, exact_quantiles

# Reductions by name: (percent of the outlier filter or None, number of splits). Fixed values.
REDUCTIONS = {
    "mean": (None, 1),
    "mean_iqr": (25, 1),
    "mean_iqr10": (10, 1),
    "mean_iqr15": (15, 1),
    "mean_iqr25": (25, 1),
    "mean_split_2": (None, 2),
    "mean_split_3": (None, 3),
    "mean_split_4": (None, 4),
    "mean_iqr15_split_2": (15, 2),
    "mean_iqr15_split_3": (15, 3),
    "mean_iqr_split_2": (25, 2),
    "mean_iqr25_split_2": (25, 2),
    "mean_iqr25_split_3": (25, 3),
}


def quantile(ordered: Column, p: float) -> Column:
    """Percentile with linear interpolation of a sorted array."""
    position = F.lit(p) * (F.size(ordered) - 1)
    low, high = F.floor(position).cast("int"), F.ceil(position).cast("int")
    at_low, at_high = F.get(ordered, low), F.get(ordered, high)
    return at_low + (at_high - at_low) * (position - low)


def iqr_bounds(q_low: Column, q_high: Column) -> tuple[Column, Column]:
    """Inclusive bounds 1.5 ranges outside the two percentiles, to 9 decimals."""
    spread = q_high - q_low
    return F.round(q_low - 1.5 * spread, 9), F.round(q_high + 1.5 * spread, 9)


def iqr_mean(values: Column, percent: int) -> Column:
    def bounds(ordered: Column) -> Column:
        low, high = iqr_bounds(quantile(ordered, percent / 100), quantile(ordered, 1 - percent / 100))
        return F.struct(low.alias("low"), high.alias("high"))

    def inside(b: Column) -> Column:
        return let(F.filter(values, lambda x: (x >= b["low"]) & (x <= b["high"])), mean)

    return let(let(F.array_sort(values), bounds), inside)


def row_means(matrix: Column, percent: int | None = None) -> Column:
    return F.transform(matrix, lambda r: mean(r) if percent is None else iqr_mean(r, percent))


def split_means(matrix: Column, splits: int, percent: int | None = None) -> Column:
    """Means of contiguous blocks of frames, block after block; the last takes the remainder."""
    frames = F.size(F.get(matrix, F.lit(0)))
    size = F.floor(frames / splits).cast("int")

    def block(b: int) -> Column:
        width = size if b < splits - 1 else frames - size * b
        return F.transform(matrix, lambda r: F.slice(r, size * b + 1, width))

    blocks = [row_means(block(b), percent) for b in range(splits)]
    return F.when(frames < splits, F.raise_error(F.lit("fewer frames than splits"))).otherwise(F.concat(*blocks))


def reduce_matrix(matrix: Column, operation: str) -> Column:
    """The named reduction; ``pca`` works on a whole table, see :func:`fit_pca`."""
    if operation not in REDUCTIONS:
        raise ValueError(f"unknown vector operation {operation!r}")
    percent, splits = REDUCTIONS[operation]
    return let(matrix, lambda m: row_means(m, percent) if splits == 1 else split_means(m, splits, percent))


def add_summary(df: DataFrame, vector: str) -> DataFrame:
    """Adds the mean and population deviation of each vector."""
    return df.withColumns({"vector_mean": mean(F.col(vector)), "vector_std": std_pop(F.col(vector))})


def transpose(matrix: Column) -> Column:
    def turned(m: Column) -> Column:
        last = F.size(F.get(m, F.lit(0))) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.transform(m, lambda r: F.get(r, j)))

    return let(matrix, turned)


def _scaled_frames(matrix: Column, centre, spread) -> Column:
    """Per frame (matrix column) (x - centre) / spread; a constant frame becomes 0."""
    def scale(column: Column) -> Column:
        moved = lambda m, s: F.transform(column, lambda x: F.coalesce(F.try_divide(x - m, s), F.lit(0.0)))
        return let(centre(column), lambda m: let(spread(column), lambda s: moved(m, s)))

    return transpose(F.transform(transpose(matrix), scale))


def minmax_frames(matrix: Column) -> Column:
    """Every frame scaled to 0..1."""
    return _scaled_frames(matrix, F.array_min, lambda c: F.array_max(c) - F.array_min(c))


def standardise_frames(matrix: Column) -> Column:
    """Every frame to mean 0 and population deviation 1."""
    return _scaled_frames(matrix, mean, std_pop)


def fit_pca(df: DataFrame, vector: str, n_components: int) -> PCAModel:
    """Principal components of a table of vectors; the d x d covariance is what reaches the driver."""
    if not n_components or n_components < 1:
        raise ValueError("n_components is required")
    rows = df.select(array_to_vector(F.col(vector)).alias("pca_in"))
    return PCA(k=n_components, inputCol="pca_in", outputCol="pca_out").fit(rows)


def apply_pca(df: DataFrame, model: PCAModel, vector: str, out: str = "reduced") -> DataFrame:
    """Projection on the components, each turned so that its largest weight is positive."""
    weights = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in weights.T]
    projected = model.transform(df.withColumn("pca_in", array_to_vector(F.col(vector))))
    turned = F.zip_with(vector_to_array("pca_out"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    return projected.withColumn(out, turned).drop("pca_in", "pca_out")


def grouped_iqr_mean(
    df: DataFrame, keys: Sequence[str], value: str, percent: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Outlier-filtered mean of long measurements per key, whatever the size of a key."""
    found = exact_quantiles(df, keys, value, [percent / 100, 1 - percent / 100], "q", rows_per_range)
    low, high = iqr_bounds(F.get("q", F.lit(0)), F.get("q", F.lit(1)))
    bounds = found.select(*keys, low.alias("low"), high.alias("high"))
    kept = null_safe_join(df, bounds, list(keys)).where(F.col(value).between(F.col("low"), F.col("high")))
    return kept.groupBy(*keys).agg(F.avg(value).alias("iqr_mean"), F.count(F.lit(1)).alias("kept"))



