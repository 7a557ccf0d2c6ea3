"""Deterministic keys and draws from SHA-256: the same on any cluster and partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def ordering_key(identity: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), identity.cast("string")), 256)


def leading_uint64(digest: Column) -> Column:
    """The first eight bytes of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def counter_draw(parts: list[Column], size: Column, attempts: int = 4) -> Column:
    """A uniform index below ``size`` (at most 2**40) addressed by its counters: the first eight
    bytes of SHA-256 of the parts and an attempt number, modulo ``size``.  Values at
    or past the largest multiple of ``size`` are drawn again; after ``attempts`` of
    those (chance below size / 2**64 each) it raises.

    The 64 bits are taken as 24, 20 and 20, so that every step fits a long; a
    draw that holds is multiplied by 1 and not put into a branch, so that its
    digest is computed once."""
    n = size.cast("long")
    step = F.lit(1 << 20)
    rest = F.lit(1 << 24) % n * step % n * step % n  # 2**64 modulo size
    tries = []
    for attempt in range(attempts):
        digest = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts), F.lit(str(attempt))), 256)
        high, middle, low = (F.conv(F.substring(digest, at, width), 16, 10).cast("long") for at, width in ((1, 6), (7, 5), (12, 5)))
        again = (high == (1 << 24) - 1) & (F.lit(1 << 40) - middle * step - low <= rest)
        index = ((high % n * step + middle) % n * step + low) % n
        tries.append(index * F.when((n <= 1 << 40) & ~again, F.lit(1)))
    # the closing literal is never reached; with it the draw isn't nullable, and joins add no filter that draws again
    return F.coalesce(*tries, F.raise_error(F.lit("no draw below the rejection limit")).cast("long"), F.lit(0).cast("long"))


def ordered_digest(lines: DataFrame, order: str, line: str, task_rows: int = 250_000) -> str:
    """SHA-256 over the text column ``line`` in the order of ``order``, which is unique.  Ranges
    are sorted and joined in tasks; the driver hashes one range after another and
    holds no more than one."""
    ranges = max(1, -(-lines.count() // task_rows))
    dealt = lines.select(order, line).repartitionByRange(ranges, order).sortWithinPartitions(order).select(line)

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"t": ["".join(frame[line])]})

    digest = hashlib.sha256()
    for row in dealt.mapInPandas(joined, "t string").toLocalIterator():
        digest.update(row.t.encode())
    return digest.hexdigest()


def ranged_digest(lines: DataFrame, order: str, line: str, width: int = 1000, levels: int = 3) -> DataFrame:
    """One row (digest): a digest of the text column ``line`` in the order of the whole number
    ``order``, which is unique.  Each ``width`` numbers are a range, whose digest is the SHA-256
    of its lines one after another; ranges are digested in the same way, ``levels`` times, and
    what is left, in order, gives the whole.  All of it runs in tasks."""
    held = lines.select(F.col(order).cast("long").alias("_o"), F.col(line).alias("_l"))

    def joined(rows: DataFrame, *by: Column) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), "")
        return rows.groupBy(*by).agg(F.sha2(text, 256).alias("_l"))

    for _ in range(levels):
        held = joined(held, F.floor(F.col("_o") / width).alias("_n")).select(F.col("_n").alias("_o"), "_l")
    return joined(held).select(F.col("_l").alias("digest"))
