"""Order tables in the roles of an event provider.

An order is a match, its date the order date, the customer's nation (modulo 5)
the competition; a line is an event of the supplier, its quantity the minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.numeric import flag_sum, floored, per_90, safe_ratio, share, total
from spanmill.operators import temporal
from spanmill.sources.scratch import written

FEATURES = ["lines_p90", "returned_p90", "return_ratio", "open_share", "mean_discount", "extra_discount_p90"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, competitionId, date)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("competitionId"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("match_id"), "competitionId", F.col("o_orderdate").alias("date"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.assign_periods(matches(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: match_id, player_id, minutes and flags."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"), F.col("l_quantity").alias("minutes"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("is_returned"), (F.col("l_returnflag") == "A").alias("is_accepted"), (F.col("l_linestatus") == "O").alias("is_open"),
    )


def sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), total(F.col("minutes")).alias("minutes_played"), flag_sum(F.col("is_returned")).alias("returned"), flag_sum(F.col("is_accepted")).alias("accepted"),
        share(F.col("is_open")).alias("open_share"), F.avg("discount").alias("mean_discount"), total(floored(F.col("discount") - 0.05)).alias("extra_discount"),
    )


def profiles(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("player_id", "period"), digits: int = 9) -> DataFrame:
    """A row per key: minutes and the six features, by one grouped aggregation."""
    rows = temporal.with_period(events(spark, sf_dir), periods(spark, sf_dir))
    m = F.col("minutes_played")
    out = sums(rows, list(keys)).select(
        *keys, m, "returned", (F.col("returned") + F.col("accepted")).alias("decided"),
        per_90(F.col("n_lines"), m).alias("lines_p90"), per_90(F.col("returned"), m).alias("returned_p90"),
        safe_ratio(F.col("returned"), F.col("returned") + F.col("accepted")).alias("return_ratio"), "open_share", "mean_discount", per_90(F.col("extra_discount"), m).alias("extra_discount_p90"),
    )
    return out.select(*keys, "minutes_played", "returned", "decided", *(F.round(f, digits).alias(f) for f in FEATURES))


def eligible(spark: SparkSession, sf_dir: str, at_least: float = 100.0, known: DataFrame | None = None) -> DataFrame:
    """Profiles of suppliers with enough minutes in both halves, with their role (nation modulo 4);
    ``known`` profiles aren't computed again.  Others are written once, since rows and the
    choice of suppliers both read them."""
    both = temporal.eligible_in_both(written(profiles(spark, sf_dir)) if known is None else known, ["player_id"], at_least)
    roles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), (F.col("s_nationkey") % 4).cast("long").alias("role"), F.col("s_nationkey").cast("long").alias("team"))
    return both.join(roles, "player_id", "left")
