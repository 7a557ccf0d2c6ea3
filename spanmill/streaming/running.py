"""Stateful streams: running figures of each entity with late rows counted, kept as a replayable table.

The state of an entity is a few numbers.  Rows of a batch are taken in the order of
their time.  A row that is older than the latest time seen from its entity by more than
``late`` still counts as a row and in the total, and is counted as late, but it opens
and extends no session; a row within ``late`` belongs to the session that is open.

``keep`` writes each micro-batch to a partition of its own and overwrites it when the
batch is run again, so a stream that is stopped between writing and committing
gives the same table after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanmill.functions.numeric import micros

STATE = "n long, cents long, last long, sessions long, active long, late long"


def running_totals(events: DataFrame, entity: str = "user_id", value: str = "value", gap_seconds: int = 1800, late_seconds: int = 600) -> DataFrame:
    """(entity, n, total_cents, last_micros, n_sessions, active_micros, n_late) of every entity that a
    micro-batch touches, after it.  ``events`` has ``ts``, the entity and a value; a null entity, time or
    value is left out.  Values are added in whole cents, so totals don't hang on the order
    of batches; a pause of more than ``gap_seconds`` opens a session, and active time is
    that within sessions."""
    gap, late = gap_seconds * 1_000_000, late_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, cents, last, sessions, active, overdue = state.get if state.exists else (0, 0, -1, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for at, amount in zip(rows["at"].tolist(), rows["cents"].tolist()):
            n, cents = n + 1, cents + amount
            if last >= 0 and at < last - late:
                overdue += 1
                continue
            pause = at - last
            if last < 0 or pause > gap:
                sessions += 1
            elif pause > 0:
                active += pause
            last = max(last, at)
        state.update((n, cents, last, sessions, active, overdue))
        yield pd.DataFrame({"e": [key[0]], "n": [n], "total_cents": [cents], "last_micros": [last], "n_sessions": [sessions], "active_micros": [active], "n_late": [overdue]})

    known = events.where(F.col(entity).isNotNull() & F.col("ts").isNotNull() & F.col(value).isNotNull())
    slim = known.select(F.col(entity).alias("e"), micros(F.col("ts"), dict(events.dtypes)["ts"]).alias("at"), F.round(F.col(value) * 100).cast("long").alias("cents"))
    kind = dict(events.dtypes)[entity]
    out = f"e {kind}, n long, total_cents long, last_micros long, n_sessions long, active_micros long, n_late long"
    return slim.groupBy("e").applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout).withColumnRenamed("e", entity)


def keep(stream: DataFrame, path: str, checkpoint: str, on_batch=None) -> None:
    """Run a stream over what is there and keep its batches under ``path``, a partition each;
    ``on_batch(number)`` is called after a batch is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(number)

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(table: DataFrame, entity: str) -> DataFrame:
    """The last batch's row of each entity."""
    newest = Window.partitionBy(entity).orderBy(F.desc("batch"))
    return table.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth", "batch")
