"""Draw plans, replicates of whole-match resampling, intervals and chance levels.

Draws are addressed by counters (SHA-256 of design, seed, replicate, stratum
and draw number), so any partitioning and any order gives the same plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.exact import exact_sums
from spanmill.functions.hashing import counter_draw
from spanmill.functions.numeric import harmonic
from spanmill.sources.scratch import written

#: Rows of two numbers that are sent to every task in place of a shuffle: 8 MB, below Spark's own threshold.
SMALL = 500_000


def draw_plan(units: DataFrame, unit: str, strata: Sequence[str], replicates: int, seed: int, design: str) -> DataFrame:
    """(replicate, strata, unit, multiplicity): each stratum is resampled with replacement to
    its own size.  The units of a stratum are numbered by id."""
    numbered = stratum_numbers(units.select(unit, *strata), unit, strata)
    # a row a unit stands for one draw; units are dealt out first, since a few strata hold them all
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = numbered.drop(unit).repartition(tasks, "_i").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = counter_draw([F.lit(design), F.lit(seed), F.col("replicate"), *(F.col(s) for s in strata), F.col("_i")], F.col("_n"))
    counts = every.select("replicate", *strata, drawn.alias("_i")).groupBy("replicate", *strata, "_i").agg(F.count("*").alias("multiplicity"))
    return counts.join(numbered.drop("_n"), [*strata, "_i"]).select("replicate", *strata, unit, "multiplicity")


def stratum_numbers(units: DataFrame, unit: str, strata: Sequence[str]) -> DataFrame:
    """``units`` with their number ``_i`` from 0 within the stratum, by id, and the stratum's size
    ``_n``.  A stratum is numbered in ranges of the id, so a large one is spread over tasks."""
    dealt = ranged(units, unit)
    sizes = dealt.groupBy(*strata, "_part").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*strata, "_part", before.alias("_before"), F.sum("_rows").over(whole).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy(unit)) - 1
    same = [F.col(f"u.{s}").eqNullSafe(F.col(f"s.{s}")) for s in strata]
    on = F.col("u._part") == F.col("s._part")
    for x in same:
        on = on & x
    met = dealt.withColumn("_within", within).alias("u").join(shifts.alias("s"), on)
    return met.select(*(F.col(f"u.{c}") for c in units.columns), (F.col("_within") + F.col("_before")).cast("long").alias("_i"), F.col("_n").cast("long"))


def ranged(rows: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``_part``, the number of the row's range among about equal ranges of a column,
    whose cuts are a scalar subquery: numbers and times by themselves, other kinds by the
    order of their first bytes."""
    ranges = ranges or max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(rows.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        lead = F.col(column).cast("long")
    elif kind in ("float", "double") or kind.startswith("decimal"):
        lead = F.col(column).cast("double")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        lead = F.unix_micros(F.col(column).cast("timestamp"))
    else:
        lead = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column).cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = rows.agg(F.coalesce(F.array_distinct(F.percentile_approx(lead, at, F.lit(100 * ranges))), F.array().cast("array<double>" if kind in ("float", "double") or kind.startswith("decimal") else "array<bigint>")).alias("_cuts"))
    part = F.lit(0)  # how many cuts aren't greater, by binary search: a few comparisons a row; beyond the last cut there is null
    for bit in reversed(range((ranges - 1).bit_length())):
        part = part + F.when(F.coalesce(F.get("_cuts", part + ((1 << bit) - 1)) <= lead, F.lit(False)), 1 << bit).otherwise(0)
    return rows.withColumn("_cuts", cuts.scalar()).withColumn("_part", part).drop("_cuts")


def resample_means(values: DataFrame, value: str, order: Sequence[str], replicates: int, seed: int, design: str = "paired") -> DataFrame:
    """(replicate, mean): means of resamples of all rows, numbered by ``order``.

    The numbering is a global order; rows are numbered by ranges, see
    ``number_rows``.  A row is ``replicates`` draws, so the few rows are dealt over all
    tasks.  A draw is joined with its row by number; up to ``SMALL`` rows are
    sent to every task, which spares a shuffle of all draws."""
    numbered, n = number_rows(written(values.select(*order, value)), list(order))
    numbered = written(numbered)
    tasks = 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.select(F.col("_i").cast("string").alias("_key")).repartition(tasks, "_key")
    draws = dealt.mapInArrow(_drawn(design, seed, replicates, n), "replicate int, _i long")
    rows = numbered.select("_i", value)
    return draws.join(F.broadcast(rows) if n <= SMALL else rows, "_i").groupBy("replicate").agg(F.avg(value).alias("mean"))


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with a global number ``_i`` from 0 in ``order``, and how many there are: ranges of
    the first column are numbered each and shifted by the rows before them."""
    dealt = ranged(rows, order[0])
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first().n
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shifts = sizes.select("_part", F.coalesce(F.sum("_rows").over(whole), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    met = dealt.withColumn("_within", within).join(F.broadcast(shifts), "_part")
    return met.withColumn("_i", (F.col("_within") + F.col("_before")).cast("long")).select(*rows.columns, "_i"), total


def cluster_resample(values: DataFrame, value: str, cluster: str, replicates: int, seed: int, design: str = "clusters") -> DataFrame:
    """(replicate, mean): clusters are drawn with replacement and their rows pooled; a row
    without cluster is an error.  Sums are exactly rounded, so that a mean doesn't hang on
    the order of its rows."""
    checked = F.when(F.col(cluster).isNull(), F.raise_error(F.lit("a row has no cluster")).cast(dict(values.dtypes)[cluster])).otherwise(F.col(cluster))
    named = values.select(checked.alias(cluster), F.col(value))
    named = written(named)
    sums = exact_sums(named, [cluster], {"_s": F.col(value)}).join(named.groupBy(cluster).agg(F.count(value).alias("_n")), cluster)
    numbered, n = number_rows(written(sums), [cluster])
    draws = numbered.select(F.col("_i").alias("_d")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = draws.select("replicate", counter_draw([F.lit(design), F.lit(seed), F.col("replicate"), F.lit("all"), F.col("_d")], F.lit(n)).alias("_i"))
    met = drawn.groupBy("replicate", "_i").agg(F.count("*").alias("_w")).join(numbered, "_i")
    met = written(met)
    total = exact_sums(met, ["replicate"], {"_t": F.col("_s") * F.col("_w")})
    counts = met.groupBy("replicate").agg(F.sum(F.col("_n") * F.col("_w")).alias("_k"))
    return total.join(counts, "replicate").select("replicate", (F.col("_t") / F.col("_k")).alias("mean"))


def interval(resamples: DataFrame, value: str, by: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bounds by position in the sorted resamples: index int(low * n) and int(high * n) - 1."""
    held = F.sort_array(F.collect_list(value))
    n = F.size("_held")
    return (
        resamples.groupBy(*by).agg(held.alias("_held"))
        .select(*by, n.cast("long").alias("n_resamples"), F.get("_held", F.floor(n * low).cast("int")).alias("ci_low"), F.get("_held", F.floor(n * high).cast("int") - 1).alias("ci_high"))
    )


def quantiles(values: DataFrame, value: str, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """Linear-interpolation (type 7) quantiles; nulls are left out."""
    out = values.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(p) for p in at))).alias("_q"))
    return out.select(*by, *(F.get("_q", i).alias(f"q{i}") for i in range(len(at))))


def summarize_replicates(values: DataFrame, value: str, by: Sequence[str], minimum: int) -> DataFrame:
    """Interval, median and availability of each group's replicate values: below ``minimum``
    valid replicates nothing is published."""
    bounds = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = values.groupBy(*by).agg(F.count(value).alias("n_valid"), bounds.alias("_q"))
    enough = F.col("n_valid") >= minimum
    named = {n: F.when(enough, F.get("_q", i)) for i, n in enumerate(("ci_low", "median", "ci_high"))}
    return out.select(*by, "n_valid", *(v.alias(k) for k, v in named.items()), F.when(enough, "available").otherwise("insufficient").alias("status"))


def summarize_ranks(ranks: DataFrame, by: Sequence[str], minimum: int, at: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Median, 95% interval and rates of each group's replicate ranks; a null rank isn't valid, and
    below ``minimum`` valid ones nothing is published."""
    enough = F.count("rank") >= minimum
    rates = [F.when(enough, F.avg((F.col("rank") <= k).cast("double"))).alias(f"rate_at_{k}") for k in at]
    bounds = F.percentile("rank", F.array(F.lit(0.025), F.lit(0.975)))
    out = ranks.groupBy(*by).agg(F.count("rank").alias("n_valid"), F.when(enough, F.median("rank")).alias("median_rank"), F.when(enough, bounds).alias("_q"), *rates)
    published = F.when(F.col("n_valid") >= minimum, "available").otherwise("insufficient")
    rest = [f"rate_at_{k}" for k in at]
    return out.select(*by, "n_valid", "median_rank", F.get("_q", 0).alias("rank_low"), F.get("_q", 1).alias("rank_high"), *rest, published.alias("status"))


def percentiles(values: DataFrame, value: str, by: Sequence[str], to: str = "percentile", valid: str | None = None) -> DataFrame:
    """Average-rank percentile 0 to 100 within each group; alone it is 50, null stays null and
    takes no part.  Where the Boolean column ``valid`` is false (an imputed value), the
    row takes part in the ranking and has no percentile itself."""
    group = Window.partitionBy(*by)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ties, n = F.count(value).over(Window.partitionBy(*by, value)), F.count(value).over(group)
    place = F.when(n == 1, F.lit(50.0)).otherwise((rank - 1 + (ties - 1) / 2) / (n - 1) * 100)
    shown = F.col(value).isNotNull() if valid is None else F.col(value).isNotNull() & F.col(valid)
    return values.withColumn(to, F.when(shown, place))


def chance_level(pools: DataFrame, pool: str = "pool_size") -> Column:
    """Aggregate column: the mean reciprocal rank of a random order, H(n) / n."""
    return F.avg(harmonic(F.col(pool)) / F.col(pool))


def _indexes(heads: Sequence[bytes], tail: bytes, size: int) -> np.ndarray:
    """The draws of ``hashing.counter_draw`` below ``size``, one for each head, whose counters end with ``tail``."""
    digest, end = hashlib.sha256, tail + b"|0"
    value = np.frombuffer(b"".join([digest(h + end).digest()[:8] for h in heads]), ">u8").astype(np.uint64)
    limit = (1 << 64) - (1 << 64) % size
    index = (value % np.uint64(size)).astype(np.int64)
    for k in np.flatnonzero(value > np.uint64(limit - 1)).tolist():
        attempt, x = 0, limit
        while x >= limit:
            attempt += 1
            x = int.from_bytes(digest(heads[k] + tail + b"|%d" % attempt).digest()[:8], "big")
        index[k] = x % size
    return index


def _drawn(design: str, seed: int, replicates: int, size: int):
    """(replicate, index): the draw of each key in every replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{design}|{seed}|{r}|".encode() for r in range(replicates)]
        numbers, some = np.arange(replicates, dtype=np.int32), 1 + 100_000 // replicates
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i in range(0, len(keys), some):
                index = np.concatenate([_indexes(heads, k.encode(), size) for k in keys[i : i + some]])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(numbers, len(index) // replicates)), pa.array(index)], ["replicate", "_i"])

    return run


def _chances(seed: int, permutations: int):
    """Sums of reciprocal ranks of every permutation over a task's queries; a rank is one plus the draw
    of ``hashing.counter_draw`` for (null, seed, permutation, key) below the pool's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [b"null|%d|%d|" % (seed, r) for r in range(permutations)]
        total, n = np.zeros(permutations), 0
        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += 1.0 / (_indexes(heads, key.encode(), size) + 1)
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations, dtype=np.int32)), pa.array(total), pa.array(np.full(permutations, n))], ["replicate", "total", "n"])

    return run


def random_null(pools: DataFrame, key: Sequence[str], observed: float, permutations: int, seed: int) -> DataFrame:
    """One row: the chance distribution of the mean reciprocal rank when each query's target is
    any of its pool, and p = (values not below the observed + 1) / (permutations + 1)."""
    # a query is thousands of draws, so the few rows are dealt over all tasks
    tasks = 4 * int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("_key")
    dealt = pools.select(named, F.col("pool_size").cast("long").alias("_n")).repartition(tasks, "_key")
    parts = dealt.mapInArrow(_chances(seed, permutations), "replicate int, total double, n long")
    mrr = parts.groupBy("replicate").agg((F.sum("total") / F.sum("n")).alias("mrr"))
    return mrr.agg(
        F.avg("mrr").alias("null_mean"), F.percentile("mrr", F.lit(0.95)).alias("null_p95"),
        ((F.count_if(F.col("mrr") >= observed) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("n_permutations"),
    )
