"""Beta-binomial shrinkage of ratios towards the mean of all profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beta_priors(profiles: DataFrame, ratios: Sequence[str], successes: str = "{}__successes", attempts: str = "{}__attempts") -> DataFrame:
    """One row of ``<ratio>__alpha`` and ``<ratio>__beta`` by the method of moments over the rates
    with attempts; (1, 1) where the moments allow no fit."""
    rates = {r: F.when(F.col(attempts.format(r)) > 0, F.col(successes.format(r)) / F.col(attempts.format(r))) for r in ratios}
    found = profiles.agg(*(x for r, v in rates.items() for x in (F.count(v).alias(f"{r}__k"), F.avg(v).alias(f"{r}__m"), F.var_samp(v).alias(f"{r}__v"))))
    out = []
    for r in ratios:
        m, v = F.col(f"{r}__m"), F.col(f"{r}__v")
        fits = (F.col(f"{r}__k") >= 2) & (m > 0) & (m < 1) & (v > 0) & (v < m * (1 - m))
        common = m * (1 - m) / v - 1
        out += [F.when(fits, m * common).otherwise(1.0).alias(f"{r}__alpha"), F.when(fits, (1 - m) * common).otherwise(1.0).alias(f"{r}__beta")]
    return found.select(*out)


def shrink(profiles: DataFrame, ratios: Sequence[str], successes: str = "{}__successes", attempts: str = "{}__attempts") -> DataFrame:
    """Each ratio replaced by (k + alpha) / (n + alpha + beta); without attempts by the prior mean."""
    wide = profiles.crossJoin(F.broadcast(beta_priors(profiles, ratios, successes, attempts)))  # one row
    made = {
        r: (F.coalesce(F.col(successes.format(r)), F.lit(0)) + F.col(f"{r}__alpha")) / (F.coalesce(F.col(attempts.format(r)), F.lit(0)) + F.col(f"{r}__alpha") + F.col(f"{r}__beta"))
        for r in ratios
    }
    return wide.withColumns(made).select(*profiles.columns)


def movement(before: DataFrame, after: DataFrame, keys: Sequence[str], ratios: Sequence[str]) -> DataFrame:
    """(ratio, mean_shift, max_shift) of the absolute changes."""
    a = before.select(*keys, *(F.col(r).alias(f"{r}__a") for r in ratios))
    b = after.select(*keys, *(F.col(r).alias(f"{r}__b") for r in ratios))
    moved = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.abs(F.col(f"{r}__a") - F.col(f"{r}__b")).alias("d")) for r in ratios))).alias("x")
    return a.join(b, list(keys)).select(moved).groupBy("x.ratio").agg(F.avg("x.d").alias("mean_shift"), F.max("x.d").alias("max_shift"))
