"""As-of, overlap and full outer joins as equi-joins on ranges, so that no plan loops over pairs.

Hot keys: an as-of key is cut into ranges of the time, which are filled apart and
carried from one to the next; overlaps meet on the key and a bucket of the time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.numeric import micros
from spanmill.operators.resampling import ranged

TIMES = ("date", "timestamp", "timestamp_ntz")


def _unused(taken: Sequence[str], name: str) -> str:
    while name in {t.lower() for t in taken}:
        name = "_" + name
    return name


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), prefix: str = "right_", tolerance: Column | None = None, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` (columns prefixed, nulls for none) of the
    same ``by`` whose ``on`` is not later (``strict``: earlier).

    Both tables are put in one, cut into ranges of ``on``; within a range the last right
    row is filled forward, and what a range begins with comes from the ranges
    before it, which have a row each.  Of right rows with one time the greatest by
    its columns counts.  A null time or key matches nothing; all left rows stay.
    ``tolerance`` is the longest distance, in the unit of ``on`` (seconds for timestamps)."""
    payload = [c for c in right.columns if c not in by]
    names = {c: f"{prefix}{c}" for c in payload}
    clash = set(names.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in both tables; choose another prefix")
    kind = right.select(F.struct(on, *(c for c in payload if c != on)).alias("r")).schema["r"].dataType
    row = F.struct(*left.columns)
    none = F.lit(None).cast(left.select(row.alias("l")).schema["l"].dataType)
    sides = left.select(*by, F.col(on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), row.alias("_l"), F.lit(None).cast(kind).alias("_r"))
    later = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), none.alias("_l"), F.struct(on, *(c for c in payload if c != on)).alias("_r"))
    every = sides.unionByName(later)
    dealt = ranged(every, "_at", ranges)
    within = Window.partitionBy(*by, "_part").orderBy("_at", "_side", "_r")
    filled = dealt.withColumn("_near", F.last("_r", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_l is not null")
    ends = dealt.groupBy(*by, "_part").agg(F.max("_r").alias("_last"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    carried = ends.select(*by, "_part", F.max("_last").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    met = filled.join(carried, [*by, "_part"], "left")
    found = F.coalesce("_near", "_before")
    known = F.col("_at").isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    if tolerance is not None:
        kind = dict(left.dtypes)[on]
        seconds = (lambda c: micros(c, kind) / 1e6) if kind in TIMES else (lambda c: c.cast("double"))
        known = known & (seconds(F.col("_at")) - seconds(F.col("_f")[on]) <= tolerance)
    out = met.withColumn("_f", found).withColumn("_f", F.when(known, F.col("_f")))
    return out.select(*(F.col("_l")[c].alias(c) for c in left.columns), *(F.col("_f")[c].alias(n) for c, n in names.items()))


def overlap_join(left: DataFrame, right: DataFrame, start: str, stop: str, by: Sequence[str] = (), prefix: str = "right_") -> DataFrame:
    """Pairs of rows of one ``by`` whose intervals [start, stop] share a point, ends included;
    right columns but ``by`` are prefixed.

    An interval belongs to the level at which a bucket is as long as it, or just longer,
    and so lies in two buckets at most.  It is copied to its own and every higher level
    that the tables have; a pair meets at the higher of its two levels, in the
    later of the two first buckets, so it is found once and long intervals are never
    cut into many pieces.  Times are whole numbers, dates or timestamps (microseconds); an interval
    with a null end or one that ends before it starts matches nothing."""
    names = {c: f"{prefix}{c}" for c in right.columns if c not in by}
    clash = set(names.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in both tables; choose another prefix")

    def number(rows: DataFrame, c: str) -> Column:
        kind = dict(rows.dtypes)[c]
        return micros(F.col(c), kind) if kind in TIMES else F.col(c).cast("long")

    def placed(rows: DataFrame, tag: str) -> DataFrame:
        a, b = number(rows, start), number(rows, stop)
        level = F.length(F.bin(b - a))  # 2**level is longer than the interval
        return rows.select(*(F.col(x).alias(x) for x in by), F.struct(*rows.columns).alias(f"_{tag}"), a.alias(f"_{tag}a"), b.alias(f"_{tag}b"), level.alias(f"_{tag}k")).where(a <= b)

    one, two = placed(left, "l"), placed(right, "r")
    levels = one.select(F.col("_lk").alias("k")).union(two.select("_rk")).agg(F.sort_array(F.collect_set("k")).alias("_levels"))  # 64 at most

    def dealt(rows: DataFrame, tag: str) -> DataFrame:
        at = rows.withColumn("_levels", levels.scalar()).withColumn("_level", F.explode(F.filter("_levels", lambda k: k >= F.col(f"_{tag}k")))).drop("_levels")
        bucket = lambda x: F.call_function("shiftright", F.col(x), F.col("_level"))
        return at.withColumn(f"_{tag}first", bucket(f"_{tag}a")).withColumn("_bucket", F.explode(F.sequence(F.col(f"_{tag}first"), bucket(f"_{tag}b"))))

    met = dealt(one, "l").join(dealt(two, "r"), [*by, "_level", "_bucket"])
    once = (F.col("_level") == F.greatest("_lk", "_rk")) & (F.col("_bucket") == F.greatest("_lfirst", "_rfirst"))
    pairs = met.where(once & (F.col("_la") <= F.col("_rb")) & (F.col("_ra") <= F.col("_lb")))
    return pairs.select(*(F.col("_l")[c].alias(c) for c in left.columns), *(F.col("_r")[c].alias(n) for c, n in names.items()))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, left_value, right_value, status): a full outer join, null keys equal; status is both,
    left or right."""
    named = lambda rows, side: rows.select(*(F.col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)), F.col(value).alias(f"{side}_value"), F.lit(True).alias(f"_{side}"))
    a, b = named(left, "left"), named(right, "right")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & a[f"_left{i}"].eqNullSafe(b[f"_right{i}"])
    out = a.join(b, on, "full")
    status = F.when(F.col("_left") & F.col("_right"), "both").when(F.col("_left"), "left").otherwise("right")
    key = [F.when(F.col("_left"), F.col(f"_left{i}")).otherwise(F.col(f"_right{i}")).alias(k) for i, k in enumerate(keys)]
    return out.select(*key, "left_value", "right_value", status.alias("status"))
