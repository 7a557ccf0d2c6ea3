"""Null-safe arithmetic and vector expressions; all are plain Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def per_90(count: Column, minutes: Column) -> Column:
    """A rate per 90 minutes, null without minutes."""
    return F.when(minutes > 0, count / minutes * 90)


def total(x: Column) -> Column:
    """Sum that is 0 for no values."""
    return F.coalesce(F.sum(x), F.lit(0))


def flag_sum(flag: Column) -> Column:
    return total(flag.cast("long"))


def share(flag: Column) -> Column:
    """Mean of a Boolean; unknown values are left out."""
    return F.avg(flag.cast("double"))


def distinct_with_null(x: Column) -> Column:
    """Distinct values, where null is one of them."""
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0))


def rescale(x: Column, size: float) -> Column:
    """A coordinate on a pitch of ``size`` as percent of it."""
    return x / size * 100.0


def floored(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def significant(x: Column, digits: int = 12) -> Column:
    """Rounded to significant decimal digits, so sums in another order give the same value."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def add_known(columns: Sequence[Column]) -> Column:
    """Sum across columns in which nulls count as 0."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 for a vector without length."""
    return F.when((norm_a > 0) & (norm_b > 0), dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def weighted(vector: Column, weights: Sequence[float]) -> Column:
    """Each element times the root of its weight: the cosine of two such vectors is the
    diagonally weighted similarity."""
    roots = F.array(*(F.lit(float(max(w, 0.0)) ** 0.5) for w in weights))
    return F.zip_with(vector, roots, lambda x, w: x * w)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: from 64 on by the asymptotic series, whose first term left out is below 1e-19."""
    some = [0.0]
    for k in range(1, 64):
        some.append(some[-1] + 1.0 / k)
    x = n.cast("double")
    square = x * x
    series = F.log(x) + 0.5772156649015329 + 0.5 / x - (1 / 12 - (1 / 120 - 1 / 252 / square) / square) / square
    return F.when(n < 64, F.get(F.array(*(F.lit(v) for v in some)), n.cast("int"))).otherwise(series)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: below 2.5 by the series of positive terms, above
    by the continued fraction; within 1e-13 of the true value, relatively above 2.5."""
    square = x * x
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")),
        lambda acc, n: F.struct((acc["t"] * square * 2 / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * square * 2 / (2 * n + 1)).alias("s")), lambda acc: acc["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / 2 / acc)
    scale = F.exp(-square) / math.sqrt(math.pi)
    return F.when(x < 2.5, 1 - 2 * scale * terms).otherwise(scale / fraction)


def micros(x: Column, kind: str) -> Column:
    """Microseconds since 1970 of a date or timestamp of Spark type ``kind``; a time without zone
    counts as UTC, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_micros(x)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x.cast("timestamp_ntz"))
