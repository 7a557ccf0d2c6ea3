"""Two chronological halves and the profiles of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_periods(matches: DataFrame, match: str = "match_id", scope: str = "competitionId", date: str = "date") -> DataFrame:
    """(match, scope, period): the earlier half of each scope's matches is A, an odd one goes
    to B; matches of one date are ordered by id.

    A scope's dates are counted and ordered, not its matches: only the date that holds the cut is
    ordered by id."""
    days = matches.groupBy(F.col(scope).alias("_scope"), F.col(date).alias("_date")).agg(F.count("*").alias("_n"))
    within = Window.partitionBy("_scope")
    before = F.sum("_n").over(within.orderBy("_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    days = days.select("_scope", "_date", "_n", (F.floor(F.sum("_n").over(within) / 2) - before).alias("_left"))  # matches still missing in A before the date
    dated = matches.join(days, matches[scope].eqNullSafe(F.col("_scope")) & matches[date].eqNullSafe(F.col("_date")))
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    period = lambda early: F.when(early, "A").otherwise("B").alias("period")
    place = F.row_number().over(Window.partitionBy(scope, date).orderBy(match))
    whole = dated.where(~cut).select(match, scope, period(F.col("_left") > 0))
    return whole.unionByName(dated.where(cut).select(match, scope, period(place <= F.col("_left"))))


def with_period(rows: DataFrame, periods: DataFrame, match: str = "match_id") -> DataFrame:
    """Rows of matches that have a period, with scope and period.  Matches are hashed, since they are fewer
    than rows, so rows aren't sorted."""
    return rows.join(periods.hint("shuffle_hash"), match)


def eligible_in_both(profiles: DataFrame, entity: list[str], at_least: float, minutes: str = "minutes_played", period: str = "period") -> DataFrame:
    """Profiles of entities that reach the minutes in both periods."""
    enough = profiles.where(F.col(minutes) >= at_least)
    both = enough.groupBy(*entity).agg(F.count_distinct(period).alias("n")).where("n = 2").select(*entity)
    return enough.join(both, entity, "left_semi")


def attach_total(rows: DataFrame, lookup: DataFrame, keys: list[str], message: str) -> DataFrame:
    """A left join that must find every row: a row without match raises when it is read."""
    marked = lookup.withColumn("_found", F.lit(True))
    out = rows.join(marked, keys, "left")
    others = [c for c in out.columns if c != "_found"]
    first = F.when(F.col("_found").isNull(), F.raise_error(F.lit(message)).cast(dict(out.dtypes)[others[0]])).otherwise(F.col(others[0]))
    return out.select(first.alias(others[0]), *others[1:])
