"""Statistics of a rating study."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.numeric import erfc


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: Krippendorff's alpha with squared differences.  Pairs are never formed: within a
    unit of m ratings the squared differences sum to 2 (m * sum of squares -
    square of the sum), and the expected ones the same over all ratings."""
    x = F.col(value).cast("double")
    units = ratings.where(x.isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m >= 2")
    pooled = units.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"))
    n = F.col("n")
    observed, expected = F.col("within") / n, 2 * (n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1))
    undefined = F.raise_error(F.lit("no unit has two ratings")).cast("double")
    return pooled.select(F.when(n.isNull(), undefined).when(expected == 0, 1.0).otherwise(1 - observed / expected).alias("alpha"), n.alias("n_ratings"))


def wilcoxon(differences: DataFrame, value: str) -> DataFrame:
    """One row (w, z, p_value, n): two-sided signed-rank test with average ranks, tie and
    continuity correction; zeros are left out.  Ranks come from the counts of
    each absolute value, so only distinct values are put in order.  Cubes of counts pass
    64 bits from two million rows on, so they are doubles."""
    d = differences.where(F.col(value) != 0).select(F.abs(value).alias("a"), (F.col(value) > 0).alias("up"))
    counts = d.groupBy("a").agg(F.count("*").alias("t"), F.count_if("up").alias("up"))
    before = F.sum("t").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("r", F.coalesce(before, F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.agg(F.coalesce(F.sum(F.col("r") * F.col("up")), F.lit(0.0)).alias("w"), F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))
    n, w = F.col("n").cast("double"), F.col("w")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    gap = w - mean
    z = F.when(var > 0, (gap - F.when(gap == 0, 0.0).otherwise(F.signum(gap) * 0.5)) / F.sqrt(var)).otherwise(0.0)
    return sums.select(w.alias("w"), z.alias("z"), "n").withColumn("p_value", F.least(F.lit(1.0), erfc(F.abs("z") / math.sqrt(2))))


def arm_means(ratings: DataFrame) -> DataFrame:
    """(query_id, arm, mean): within each rater first, then across raters."""
    by_rater = ratings.groupBy("query_id", "arm", "rater_id").agg(F.avg("rating").alias("m"))
    return by_rater.groupBy("query_id", "arm").agg(F.avg("m").alias("mean"))


def paired_differences(means: DataFrame, first: str, second: str) -> DataFrame:
    a, b = (means.where(F.col("arm") == arm).select("query_id", F.col("mean").alias(n)) for arm, n in ((first, "a"), (second, "b")))
    return a.join(b, "query_id").select("query_id", (F.col("a") - F.col("b")).alias("difference"))


def decide(alpha: float, primary_low: float, primary_p: float, floor_low: float, gate: float = 0.4) -> str:
    """REDESIGN if raters don't agree, NO-GO if not better than random, GO if the primary
    contrast is positive, else NO-GO."""
    if alpha < gate:
        return "REDESIGN"
    if floor_low <= 0:
        return "NO-GO"
    return "GO" if primary_low > 0 and primary_p < 0.05 else "NO-GO"


def blinded_arms(pool: DataFrame, query: str, arm_orders: dict, per_arm: int = 5) -> DataFrame:
    """``pool`` (query, candidate, score columns) -> (query, candidate, arm): each arm in turn takes
    the best ``per_arm`` candidates by its order that no arm before has taken."""
    taken, left = None, pool
    for arm, order in arm_orders.items():
        best = Window.partitionBy(query).orderBy(*order)
        chosen = left.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_arm).select(query, "candidate", F.lit(arm).alias("arm"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        left = left.join(chosen.select(query, "candidate"), [query, "candidate"], "left_anti")
    return taken


def keyed_order(seed: int, *columns: str) -> list:
    """Sort keys of a repeatable random order: a digest of the seed and the columns, then the columns."""
    return [F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)), 256), *(F.col(c) for c in columns)]


def rating_sheet(arms: DataFrame, query: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """``arms`` (query, candidate, arm) -> the raters' sheet (query, position, candidate), each
    query's candidates in keyed order without their arm, and the key (query, position, arm)."""
    order = Window.partitionBy(query).orderBy(*keyed_order(seed, query, "candidate"))
    dealt = arms.withColumn("position", F.row_number().over(order))
    return dealt.select(query, "position", "candidate"), dealt.select(query, "position", "arm")


def cards(sheet: DataFrame, profiles: DataFrame, key: str, stats: Sequence[str], digits: int = 3) -> DataFrame:
    """The sheet with each candidate's attributes: ``profiles`` (key, minutes_played, stats and any
    more columns); minutes are whole, stats rounded, and a candidate without
    profile keeps an empty card."""
    shown = profiles.withColumns({"minutes_played": F.round("minutes_played", 0), **{s: F.round(s, digits) for s in stats}})
    return sheet.join(shown.withColumnRenamed(key, "candidate"), "candidate", "left")
