"""Sums of doubles that are rounded once, whatever the partitioning.

A double is split without error into digits of 24 bits at fixed powers of two;
digits of one power are whole numbers and are added as such, so partial sums
merge in any order.  Only the last step rounds: carries are settled and the
whole is rounded to the nearest double, ties to even, as an exactly rounded sum does.

Nulls are left out; a group of nulls alone has a null sum.  NaN, or infinities of
both signs, give NaN; one infinity gives itself; a sum beyond the largest double
is an infinity.  A power's digits add up exactly for 2**39 rows a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit, and digits that a double may touch (53 bits, and one for an exponent guessed too high).
BITS, SPLIT = 24, 5
#: Powers that stand for what isn't a digit.
SEEN, NAN, PLUS, MINUS, NULL = 900, 901, 902, 903, 904


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _scaled(x: Column, power: Column) -> Column:
    """x * 2**power in two exact steps, so that neither factor overflows."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def split(x: Column) -> Column:
    """array<struct<k, d>>: x is the sum of d * 2**(24 k); marks for null, NaN and infinities."""
    mark = lambda k: F.struct(F.lit(k).alias("k"), F.lit(1).cast("long").alias("d"))
    top = F.floor((F.floor(F.log2(F.abs(x))) + 1) / BITS).cast("int")

    def step(state: Column, j: Column) -> Column:
        whole = state["y"].cast("long")
        digit = F.struct((state["k"] - j).cast("int").alias("k"), whole.alias("d"))
        return F.struct(state["k"].alias("k"), ((state["y"] - whole) * float(1 << BITS)).alias("y"), F.concat(state["out"], F.array(digit)).alias("out"))

    def digits(k: Column) -> Column:
        start = F.struct(k.alias("k"), _scaled(x, (-BITS * k).cast("double")).alias("y"), F.array().cast("array<struct<k:int,d:bigint>>").alias("out"))
        made = F.aggregate(F.sequence(F.lit(0), F.lit(SPLIT - 1)), start, step, lambda s: s["out"])
        return F.concat(F.array(mark(SEEN)), F.filter(made, lambda p: p["d"] != 0))

    special = F.when(F.isnan(x), F.array(mark(NAN))).when(x == float("inf"), F.array(mark(PLUS))).when(x == float("-inf"), F.array(mark(MINUS))).when(x == 0, F.array(mark(SEEN)))
    return F.when(x.isNull(), F.array(mark(NULL))).otherwise(F.coalesce(special, _let(top, digits)))


def _settled(digits: Column, low: Column, high: Column, sign: int) -> Column:
    """struct<carry, d>: digits 0 to 2**24 - 1 from power ``low`` on."""
    held = F.map_from_entries(digits)

    def step(state: Column, k: Column) -> Column:
        s = state["carry"] + F.coalesce(F.try_element_at(held, k), F.lit(0).cast("long")) * sign
        return F.struct(F.shiftright(s, BITS).alias("carry"), F.concat(state["d"], F.array(s.bitwiseAND((1 << BITS) - 1))).alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("d"))
    return F.aggregate(F.sequence(low, high), start, step)


def _nearest(d: Column, low: Column) -> Column:
    """The double nearest to the digits' value, ties to even."""
    shift = lambda name, x, n: F.call_function(name, x, n.cast("int"))
    at = lambda i: F.coalesce(F.when(i >= 0, F.get(d, i)), F.lit(0).cast("long"))
    one = F.lit(1).cast("long")

    def rounded(t: Column) -> Column:
        bits = F.length(F.bin(at(t)))
        cut = bits + 19  # of the lower 48 bits; 53 stay
        high, low48 = at(t) * (1 << BITS) + at(t - 1), at(t - 2) * (1 << BITS) + at(t - 3)
        mantissa = shift("shiftleft", high, 29 - bits).bitwiseOR(shift("shiftright", low48, cut))
        rest, half = low48.bitwiseAND(shift("shiftleft", one, cut) - 1), shift("shiftleft", one, cut - 1)
        more = F.exists(F.slice(d, F.lit(1), F.greatest(t - 3, F.lit(0))), lambda x: x != 0)
        up = (rest > half) | ((rest == half) & (more | (mantissa.bitwiseAND(1) == 1)))
        return _scaled((mantissa + up.cast("long")).cast("double"), (BITS * (low + t - 3) + cut).cast("double"))

    # the highest digit that isn't 0
    top = F.aggregate(F.sequence(F.lit(0), F.size(d) - 1), F.lit(-1), lambda best, i: F.when(F.get(d, i) != 0, i).otherwise(best))
    return _let(top, lambda t: F.when(t < 0, F.lit(0.0)).otherwise(rounded(t)))


def merged(parts: Column) -> Column:
    """The rounded sum of array<struct<k, d>> with every power once."""
    known = lambda k: F.exists(parts, lambda p: p["k"] == k)
    digits = F.filter(parts, lambda p: p["k"] < SEEN)

    def total(digits: Column) -> Column:
        low, high = F.array_min(F.transform(digits, lambda p: p["k"])), F.array_max(F.transform(digits, lambda p: p["k"])) + 4
        positive = _settled(digits, low, high, 1)
        return _let(positive, lambda s: F.when(s["carry"] < 0, -_nearest(_settled(digits, low, high, -1)["d"], low)).otherwise(_nearest(s["d"], low)))

    finite = _let(digits, lambda x: F.when(F.size(x) > 0, total(x)).when(known(SEEN), F.lit(0.0)))
    nan = known(NAN) | (known(PLUS) & known(MINUS))
    return F.when(nan, F.lit(float("nan"))).when(known(PLUS), F.lit(float("inf"))).when(known(MINUS), F.lit(float("-inf"))).otherwise(finite)


def _digits(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, k, d) pieces of finite doubles: the sum of a row's d * 2**(24 k) is the row's value."""
    mantissa, exponent = np.frexp(x)
    whole, power = np.abs(mantissa * 2.0**53).astype(np.int64), exponent.astype(np.int64) - 53
    sign, k, low = np.where(x < 0, -1, 1), power // BITS, (1 << BITS) - 1
    out = []
    for i in range(3):
        part = (whole >> (BITS * i) & low) << power % BITS
        for up, d in ((0, part & low), (1, part >> BITS)):
            at = np.flatnonzero(d)
            out.append((at, k[at] + i + up, (d * sign)[at]))
    return out


def _batch_sums(by: Sequence[str]):
    """A batch's rows as sums of digits by group and power, marks of other values among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(batch.num_columns - 1)
            null = np.asarray(value.is_null())
            x = value.to_numpy(zero_copy_only=False)
            finite = np.isfinite(x) & ~null
            pieces = _digits(np.where(finite, x, 0.0))
            for mark, there in ((NULL, null), (NAN, np.isnan(x) & ~null), (PLUS, np.isposinf(x)), (MINUS, np.isneginf(x)), (SEEN, finite)):
                at = np.flatnonzero(there)
                pieces.append((at, np.full(len(at), mark), np.ones(len(at), np.int64)))
            at, k, d = (np.concatenate(p) for p in zip(*pieces))
            columns = [batch.column(i).take(pa.array(at)) for i in range(len(by))]
            names = [f"b{i}" for i in range(len(by))]
            held = pa.table([*columns, pa.array(k, pa.int32()), pa.array(d, pa.int64())], names=[*names, "k", "d"])
            sums = held.group_by([*names, "k"], use_threads=False).aggregate([("d", "sum")]).select([*names, "k", "d_sum"])
            yield from sums.rename_columns([*by, "k", "d"]).to_batches()

    return run


def partial_sums(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """(by, k, d): what a set of rows adds up to, a row for each group and power; two such
    tables are merged by adding up d again."""
    named = rows.select(*by, value.cast("double").alias("_x"))
    kinds = dict(named.dtypes)
    parts = named.mapInArrow(_batch_sums(by), ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "k int, d long"]))
    return parts.groupBy(*by, "k").agg(F.sum("d").alias("d"))


def merge_sums(partials: DataFrame, by: Sequence[str], to: str = "total") -> DataFrame:
    """(by, to): the exactly rounded sums of partial sums, of however many tables."""
    met = partials.groupBy(*by, "k").agg(F.sum("d").alias("d"))
    return met.groupBy(*by).agg(F.collect_list(F.struct("k", "d")).alias("_parts")).select(*by, merged(F.col("_parts")).alias(to))


def exact_sums(rows: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(by, a column for each of ``values``): exactly rounded sums; groups whose values are all
    null keep their row, with a null."""
    named = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()))).alias("_v")).select(*by, "_v.*")
    summed = merge_sums(partial_sums(named, [*by, "name"], F.col("value")), [*by, "name"])
    return summed.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.struct("total")))["total"].alias(n) for n in values))
