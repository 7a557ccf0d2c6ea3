"""Mergeable sketches kept as binary columns: distinct counts, quantiles, frequent values.

A table of sketches by group (a period of a competition, say) is made once; any
coarser group is their union, without the rows.  Bounds hold with the sizes below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the buckets of a distinct sketch (relative error about 1.04 / sqrt of them), nominal entries of a set
#: sketch (about 1 / sqrt), and size of a quantile sketch (rank error about 1.33 % at 200, less at more).
LG_BUCKETS, LG_ENTRIES, QUANTILE_SIZE, TRACKED = 12, 14, 400, 1000


def sketches(rows: DataFrame, by: Sequence[str], distinct: str, value: str, item: str) -> DataFrame:
    """(by, n, distinct_sketch, set_sketch, value_sketch, item_sketch) of every group."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG_BUCKETS).alias("distinct_sketch"), F.theta_sketch_agg(distinct, LG_ENTRIES).alias("set_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("value_sketch"), F.expr(f"approx_top_k_accumulate(`{item}`, {TRACKED})").alias("item_sketch"),
    )


def union(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, from those of their parts."""
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch", True).alias("distinct_sketch"), F.theta_union_agg("set_sketch", LG_ENTRIES).alias("set_sketch"),
        F.kll_merge_agg_double("value_sketch", QUANTILE_SIZE).alias("value_sketch"), F.expr(f"approx_top_k_combine(item_sketch, {TRACKED})").alias("item_sketch"),
    )


def n_distinct(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def n_in_set(sketch: str) -> Column:
    return F.theta_sketch_estimate(sketch)


def n_in_both(a: Column, b: Column) -> Column:
    """Distinct values that two groups share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def quantile(sketch: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))


def within_quantiles(sketch: str, q: float, value: Column, error: float) -> Column:
    """Whether ``value`` lies between the quantiles ``q - error`` and ``q + error``."""
    return value.between(quantile(sketch, max(0.0, q - error)), quantile(sketch, min(1.0, q + error)))


def frequent(sketch: str, k: int) -> Column:
    """array<struct<item, count>>: the most frequent values first."""
    return F.expr(f"approx_top_k_estimate(`{sketch}`, {k})")
