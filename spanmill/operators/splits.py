"""Disjoint train, validation and test splits within each role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.hashing import ordered_digest, ordering_key, ranged_digest


def assign_splits(players: DataFrame, entity: str = "player_id", role: str = "role", seed: int = 20260716, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """(entity, role, split): each role's members in the order of a seeded hash, cut at
    int(n * train) and int(n * (train + validation)).  A repeated entity or an
    unknown role is an error."""
    within = Window.partitionBy(role)
    again = F.count("*").over(Window.partitionBy(entity))
    ok = F.when(again > 1, F.raise_error(F.lit("an entity has several rows")).cast("string")).when(F.col(role).isNull(), F.raise_error(F.lit("an entity has no role")).cast("string")).otherwise(F.col(role))
    keyed = players.select(entity, ok.alias(role)).withColumn("_key", ordering_key(F.col(entity), seed))
    place, n = F.row_number().over(within.orderBy("_key", entity)), F.count("*").over(within)
    split = F.when(place <= F.floor(n * F.lit(train)), "train").when(place <= F.floor(n * F.lit(train + validation)), "validation").otherwise("test")
    return keyed.select(entity, role, split.alias("split"))


def split_counts(assignment: DataFrame, role: str = "role") -> DataFrame:
    return assignment.groupBy(role, "split").agg(F.count("*").alias("n"))


def assignment_digest(assignment: DataFrame, entity: str = "player_id", task_rows: int = 250_000) -> DataFrame:
    """One row: SHA-256 over ``entity:split`` lines in the order of entities."""
    line = F.concat(F.col(entity).cast("string"), F.lit(":"), F.col("split"), F.lit("\n"))
    digest = ordered_digest(assignment.select(entity, line.alias("_line")), entity, "_line", task_rows)
    return assignment.sparkSession.createDataFrame([(digest,)], "digest string")


def assignment_tree_digest(assignment: DataFrame, entity: str = "player_id") -> DataFrame:
    """One row: a digest of the same lines that is made in tasks, by ranges of whole-number entities."""
    line = F.concat(F.col(entity).cast("string"), F.lit(":"), F.col("split"), F.lit("\n"))
    return ranged_digest(assignment.select(entity, line.alias("_line")), entity, "_line")
