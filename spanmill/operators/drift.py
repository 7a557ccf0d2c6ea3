"""A gate between stored and recomputed tables that stops the job at the first difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated(computed: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], within: float) -> DataFrame:
    """``computed`` as it is, if every key and column agrees with ``stored``.  A key that only one
    side has, a null against a value (NaN counts as a value equal to itself) and a difference beyond
    ``within`` raise an error that names the key, in the task that meets it; null keys are
    equal.  Both tables are read once and joined on the keys."""
    side = lambda rows, names, tag: rows.select(*(F.col(k).alias(f"_{tag}k{i}") for i, k in enumerate(keys)), F.struct(*names).alias(f"_{tag}"), F.lit(True).alias(f"_{tag}there"))
    a, b = side(computed, computed.columns, "a"), side(stored, columns, "b")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & a[f"_ak{i}"].eqNullSafe(b[f"_bk{i}"])
    met = a.join(b, on, "full")

    def differs(c: str) -> Column:
        x, y = F.col("_a")[c].cast("double"), F.col("_b")[c].cast("double")
        return (x.isNull() != y.isNull()) | F.coalesce(~((x == y) | (F.abs(x - y) <= within)), F.lit(False))

    named = lambda tag: F.concat_ws(", ", *(F.coalesce(F.col(f"_{tag}k{i}").cast("string"), F.lit("null")) for i in range(len(keys))))
    fault = F.when(F.col("_athere").isNull(), F.concat(F.lit("not computed: "), named("b"))).when(F.col("_bthere").isNull(), F.concat(F.lit("not stored: "), named("a")))
    for c in columns:
        fault = fault.when(differs(c), F.concat(F.lit(f"{c} drifted: "), named("a")))
    kinds = dict(computed.dtypes)
    first = computed.columns[0]
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(kinds[first])).otherwise(F.col("_a")[first])
    return met.select(checked.alias(first), *(F.col("_a")[c].alias(c) for c in computed.columns[1:]))
