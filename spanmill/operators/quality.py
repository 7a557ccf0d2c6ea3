"""Data-quality checks: they report and never repair.  A result row is
(check_name, n_checked, n_bad, status); the checks of a table share one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.numeric import distinct_with_null


@dataclass(frozen=True)
class Check:
    """A check that one aggregation over the table answers."""

    name: str
    bad: Column
    checked: Column
    #: status when something is bad
    severity: str = "fail"


def unique_key(key: str) -> Check:
    """Null counts as one value."""
    return Check(f"unique({key})", F.count("*") - distinct_with_null(F.col(key)), F.count("*"))


def unique_together(*keys: str) -> Check:
    return Check(f"unique({','.join(keys)})", F.count("*") - F.count_distinct(F.struct(*keys)), F.count("*"))


def required(*columns: str) -> list[Check]:
    return [Check(f"not_null({c})", F.count_if(F.col(c).isNull()), F.count("*")) for c in columns]


def no_negative(column: str) -> Check:
    return Check(f"no_negative({column})", F.count_if(F.col(column) < 0), F.count(column))


def in_range(column: str, low: float, high: float) -> Check:
    return Check(f"range({column})", F.count_if(~F.col(column).between(low, high)), F.count(column))


def at_least_rows(n: int) -> Check:
    return Check(f"rows>={n}", (F.count("*") < n).cast("long"), F.count("*"))


def sentinel_zero(column: str) -> Check:
    return Check(f"zero_sentinel({column})", F.count_if(F.col(column) == 0), F.count(column), "warn")


def two_nulls(column: str) -> Check:
    """Bad only if both null and the empty text occur."""
    null, empty = F.count_if(F.col(column).isNull()), F.count_if(F.col(column) == "")
    return Check(f"two_nulls({column})", F.when((null > 0) & (empty > 0), null + empty).otherwise(F.lit(0)), F.count("*"), "warn")


def rare_flag(flag: Column, name: str, most: float = 0.05) -> Check:
    """Bad rows count only if they are more than the share ``most``."""
    n = F.count_if(flag)
    return Check(f"rare({name})", F.when(n > most * F.count("*"), n).otherwise(F.lit(0)), F.count("*"), "warn")


def run_checks(table: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks in one aggregation, then a row for each."""
    one = table.agg(*(x for i, c in enumerate(checks) for x in (c.bad.alias(f"b{i}"), c.checked.alias(f"n{i}"))))
    rows = F.array(
        *(F.struct(F.lit(c.name).alias("check_name"), F.col(f"n{i}").cast("long").alias("n_checked"), F.col(f"b{i}").cast("long").alias("n_bad"), F.lit(c.severity).alias("severity")) for i, c in enumerate(checks))
    )
    return one.select(F.explode(rows).alias("r")).select("r.check_name", "r.n_checked", "r.n_bad", F.when(F.col("r.n_bad") > 0, F.col("r.severity")).otherwise("ok").alias("status"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str, sentinels: Sequence = (), samples: int = 5) -> DataFrame:
    """Distinct child keys (nulls and sentinels left out) without a parent; one result row, with
    the smallest few as samples."""
    values = child.where(F.col(key).isNotNull())
    values = (values.where(~F.col(key).isin(*sentinels)) if sentinels else values).select(F.col(key).alias("k")).distinct()
    tagged = values.join(parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("known")).distinct(), "k", "left")
    lost = F.col("known").isNull()
    few = tagged.where(lost).orderBy("k").limit(samples).agg(F.sort_array(F.collect_list("k")).alias("samples"))
    one = tagged.agg(F.count("*").alias("n_checked"), F.count_if(lost).alias("n_bad"))
    return one.crossJoin(F.broadcast(few)).select(  # two tables of one row
        F.lit(f"foreign_key({name})").alias("check_name"), "n_checked", "n_bad", F.when(F.col("n_bad") > 0, "fail").otherwise("ok").alias("status"), "samples"
    )


def coverage(used: DataFrame, column: str, mapping: DataFrame, mapped: str, label: str, samples: int = 5) -> DataFrame:
    """Distinct values in use that a mapping lacks; an array column counts each of its elements,
    and an empty array none."""
    if dict(used.dtypes)[column].startswith("array"):
        used = used.select(F.explode_outer(column).alias(column))
    return orphans(used, column, mapping, mapped, label, samples=samples).withColumn("check_name", F.lit(f"mapping_coverage({label})"))


def same_set(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """One result row: distinct rows that only one of two tables has (nulls are equal)."""
    a, b = left.distinct(), right.distinct()
    sides = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(0)))
    each = sides.groupBy(*left.columns).agg(F.count("*").alias("_n"))
    return run_checks(each, [Check(f"same_set({name})", F.count_if(F.col("_n") == 1), F.count("*"))])


def coordinate_bounds(events: DataFrame, positions: str = "positions", low: float = 0, high: float = 100) -> DataFrame:
    """Per axis: points outside the bounds, with their percentage.  An event without points gives one
    whose coordinates are unknown, and those aren't checked."""
    points = events.select(F.explode_outer(positions).alias("p")).select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"p.{a}").cast("double").alias("v")) for a in "xy"))).alias("a")).select("a.*")
    known = points.where(F.col("v").isNotNull())
    return known.groupBy("axis").agg(F.count("*").alias("n_checked"), F.count_if(~F.col("v").between(low, high)).alias("n_bad"), (F.avg((~F.col("v").between(low, high)).cast("double")) * 100).alias("percent_bad"))


def missing_columns(table: DataFrame, wanted: Sequence[str]) -> list[str]:
    return sorted(set(wanted) - set(table.columns))


def suite(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("check_name", "n_checked", "n_bad", "status") for p in parts])


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def report(results: DataFrame) -> str:
    """Markdown of a suite's results (a row per check)."""
    lines = ["| check | checked | bad | status |", "|---|---|---|---|"]
    lines += [f"| {r.check_name} | {r.n_checked} | {r.n_bad} | {r.status} |" for r in results.orderBy("check_name").collect()]
    return "\n".join(lines)
