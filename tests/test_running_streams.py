"""A stateful stream that is stopped, broken and resumed gives the table of one that ran through."""

from __future__ import annotations

import datetime
import random

import pytest

from spanmill.streaming import running

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minute):
    return START + datetime.timedelta(minutes=minute)


def plain(batches):
    state = {}
    for rows in batches:
        for user in {u for u, t, v in rows if None not in (u, t, v)}:
            n, cents, last, sessions, active, late = state.get(user, (0, 0, None, 0, 0.0, 0))
            for _, t, v in sorted((r for r in rows if r[0] == user and None not in r), key=lambda r: r[1]):
                n, cents = n + 1, cents + round(v * 100)
                if last is not None and t < last - 10:
                    late += 1
                    continue
                if last is None or t - last > 30:
                    sessions += 1
                elif t > last:
                    active += t - last
                last = t if last is None else max(last, t)
            state[user] = (n, cents, last, sessions, active, late)
    return state


def test_restart_and_failure_change_nothing(spark, tmp_path):
    rng = random.Random(6)
    batches = [[(rng.choice([1, 2, 3, None]), rng.choice([None, *range(60 * i, 60 * i + 90)]), rng.choice([None, 1.25, 2.5])) for _ in range(30)] for i in range(4)]
    batches[2].append((1, 3, 7.0))  # long overdue
    schema = "user_id long, ts timestamp, value double"

    def deliver(folder, k):
        rows = [(u, None if t is None else at(t), v) for u, t, v in batches[k]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def stream(folder):
        return running.running_totals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))

    def table(folder):
        rows = running.latest(spark.read.parquet(str(folder)), "user_id").collect()
        return {r.user_id: (r.n, r.total_cents, (r.last_micros - int(START.timestamp() * 1e6)) / 6e7, r.n_sessions, r.active_micros / 6e7, r.n_late) for r in rows}

    source, out, check = tmp_path / "in", tmp_path / "out", str(tmp_path / "check")
    deliver(source, 0)
    running.keep(stream(source), str(out), check)
    deliver(source, 1)

    def breaks(number):
        raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        running.keep(stream(source), str(out), check, on_batch=breaks)
    running.keep(stream(source), str(out), check)
    for k in (2, 3):
        deliver(source, k)
        running.keep(stream(source), str(out), check)
    want = plain(batches)
    got = table(out)
    rounded = lambda t: {k: tuple(round(x, 6) for x in v) for k, v in t.items()}
    assert rounded(got) == rounded(want) and sum(late for *_, late in got.values()) >= 1
    running.keep(stream(source), str(out), check)  # nothing new
    assert table(out) == got
