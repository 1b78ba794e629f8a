"""Column expressions over ``array<double>`` vectors; they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("cosine", "correlation", "l2", "euclidean", "manhattan", "inner_product")

# Other spellings accepted for a metric (fixed values).
METRIC_ALIASES = {
    "COSINE": "cosine",
    "L2": "l2",
    "IP": "inner_product",
}


def metric_name(name: str) -> str:
    metric = METRIC_ALIASES.get(name, name)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {name!r}, expected one of {METRICS}")
    return metric


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column used inside a lambda is evaluated again for every element; as the variable of
    an outer lambda it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def same_size(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error when the two vectors differ in size (zip_with would pad with nulls)."""
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors of different size"))
    )


def array_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return same_size(a, b, array_sum(F.zip_with(a, b, lambda x, y: x * y)))


def squared_l2(a: Column, b: Column) -> Column:
    return same_size(a, b, array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return same_size(a, b, array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def norm(vector: Column) -> Column:
    return F.sqrt(array_sum(F.transform(vector, lambda x: x * x)))


def mean(vector: Column) -> Column:
    return F.try_divide(array_sum(vector), F.size(vector))


def std_pop(vector: Column) -> Column:
    def spread(centre: Column) -> Column:
        return array_sum(F.transform(vector, lambda x: (x - centre) * (x - centre)))

    return F.sqrt(F.try_divide(let(mean(vector), spread), F.size(vector)))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""
    return let(norm(vector), lambda n: F.when(n == 0, vector).otherwise(F.transform(vector, lambda x: x / n)))


def centred_unit(vector: Column) -> Column:
    """Vector centred by its own mean, then L2-normalised."""
    return let(let(mean(vector), lambda m: F.transform(vector, lambda x: x - m)), unit)


def prepare(vector: Column, metric: str) -> Column:
    """The form of a vector that turns cosine and correlation into a dot product."""
    metric = metric_name(metric)
    if metric == "cosine":
        return unit(vector)
    if metric == "correlation":
        return centred_unit(vector)
    return vector


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vectors, smaller is nearer (inner product: negated similarity)."""
    metric = metric_name(metric)
    if metric in ("cosine", "correlation"):
        return let(prepare(a, metric), lambda x: let(prepare(b, metric), lambda y: 1.0 - dot(x, y)))
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "euclidean":
        return F.sqrt(squared_l2(a, b))
    if metric == "manhattan":
        return manhattan(a, b)
    return -dot(a, b)


def with_stats(vector: Column) -> Column:
    """Vector with its mean and population deviation appended."""
    return F.concat(vector, F.array(mean(vector), std_pop(vector)))


def combine(*vectors: Column) -> Column:
    return F.concat(*vectors)


def dimension(df: DataFrame, vector: str) -> int:
    """Vector length, read off one row; jobs that use it check every other row."""
    row = df.select(F.size(vector).alias("d")).where(F.col("d") > 0).head(1)
    if not row:
        raise ValueError("no vectors")
    return row[0]["d"]


def scale_minmax(vector: Column, low: Column, high: Column) -> Column:
    """(x-low)/(high-low) per dimension, not clipped; a constant dimension divides by 1."""
    spans = F.zip_with(high, low, lambda h, l: F.when(h == l, F.lit(1.0)).otherwise(h - l))
    shifted = F.zip_with(vector, low, lambda x, l: x - l)
    return same_size(vector, low, F.zip_with(shifted, spans, lambda x, s: x / s))


def sq8_encode(vector: Column, low: Column, high: Column) -> Column:
    """One 0..255 code per dimension; a constant dimension has code 0."""
    unit_range = F.zip_with(
        F.zip_with(vector, low, lambda x, l: x - l),
        F.zip_with(high, low, lambda h, l: h - l),
        lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s),
    )
    code = F.transform(unit_range, lambda u: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(u * 255).cast("int"))))
    return code.cast("array<smallint>")


def sq8_decode(code: Column, low: Column, high: Column) -> Column:
    """The middle of the code's step; a constant dimension decodes to its value."""
    steps = F.zip_with(
        code,
        F.zip_with(high, low, lambda h, l: h - l),
        lambda c, s: F.when(s == 0, F.lit(0.0)).otherwise((c + F.lit(0.5)) / 255 * s),
    )
    return F.zip_with(steps, low, lambda x, l: x + l)


def frames_of(flat: Column, n_rows: int) -> Column:
    """A flat vector read as a matrix of ``n_rows`` equally long rows."""
    width = (F.size(flat) / n_rows).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda r: F.slice(flat, r * width + 1, width))
