"""Primary teams, transfers, concentration of neighbours and family ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_value(minutes: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """For each key the value with the largest total weight (ties: the smaller value)."""
    summed = minutes.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return summed.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_w"), -F.col(value).cast("long"))).alias(value))


def transferred(eligible: DataFrame, primary: DataFrame, entity: list[str], team: str = "team_id") -> DataFrame:
    """Entities whose primary team differs between A and B; an unknown team isn't a transfer."""
    of = lambda p: primary.where(F.col("period") == p).select(*entity, F.col(team).alias(f"{team}_{p.lower()}"))
    pairs = eligible.select(*entity).distinct().join(of("A"), entity, "left").join(of("B"), entity, "left")
    return pairs.where(F.col(f"{team}_a") != F.col(f"{team}_b"))


def concentration(neighbors: DataFrame, query_attribute: DataFrame, neighbor_attribute: DataFrame, entity: list[str], attribute: str, include_true: bool = False) -> DataFrame:
    """One row: the share of neighbour pairs with equal attribute.  True matches are left out
    unless asked for, an unknown attribute counts as different, no pairs give
    0, and an attribute table with repeated keys is an error."""

    def once(table: DataFrame, keys: list[str], name: str) -> DataFrame:
        one = table.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(attribute).alias(name))
        good = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated keys in {attribute}")).cast(dict(one.dtypes)[name])).otherwise(F.col(name))
        return one.withColumn(name, good).drop("_n")

    pairs = neighbors if include_true else neighbors.where(~F.col("is_true_match"))
    left = once(query_attribute, entity, "_q")
    right = once(neighbor_attribute, entity, "_c").withColumnsRenamed({e: f"neighbor_{e}" for e in entity})
    joined = pairs.join(left, entity, "left").join(right, [f"neighbor_{e}" for e in entity], "left")
    return joined.agg(F.coalesce(F.avg(F.coalesce(F.col("_q") == F.col("_c"), F.lit(False)).cast("double")), F.lit(0.0)).alias("concentration"))
