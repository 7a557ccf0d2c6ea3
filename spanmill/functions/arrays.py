"""Tags and positions of an event."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_ids(tags: Column) -> Column:
    return F.transform(tags, lambda t: t["id"])


def has_any_tag(tags: Column, ids: Iterable[int]) -> Column:
    """Whether any tag is one of ``ids``: false for no tags, null for null."""
    held = tags["id"]
    return reduce(or_, (F.array_contains(held, F.lit(i).cast("long")) for i in ids))


def point(positions: Column, i: int, axis: str) -> Column:
    """A coordinate of the i-th position, null where there is none."""
    return F.get(positions, i)[axis]
