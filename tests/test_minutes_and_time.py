"""Minutes, stints, period splits and eligibility."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators import minutes, temporal


def match(spark, lineup, bench=(), subs="null", duration="Regular"):
    def player(p):
        pid, red = p if isinstance(p, tuple) else (p, "0")
        return {"playerId": pid, "redCards": red, "goals": "0", "ownGoals": "0", "yellowCards": "0"}

    teams = {"7": {"hasFormation": 1, "formation": {"lineup": [player(p) for p in lineup], "bench": [player(p) for p in bench], "substitutions": subs}}}
    return spark.createDataFrame([(1, 10, duration, json.dumps(teams))], "wyId long, competitionId long, duration string, teamsData string")


def by_player(df):
    return {r.player_id: (r.started, r.minute_in, r.minute_out, r.minutes_played, r.derivation_status) for r in df.collect()}


def test_full_match_and_unused_bench(spark):
    got = by_player(minutes.lineup_minutes(match(spark, [100], [200])))
    assert got == {100: (True, 0, 90, 90, "clean"), 200: (False, None, None, 0, "clean")}


def test_substitutions_cards_and_conflicts(spark):
    subs = [{"playerIn": 200, "playerOut": 100, "minute": 60}, {"playerIn": 201, "playerOut": 101, "minute": 94}]
    got = by_player(minutes.lineup_minutes(match(spark, [100, 101, (102, "30"), (103, "null")], [200, 201], subs)))
    assert got[100] == (True, 0, 60, 60, "clean") and got[200] == (False, 60, 90, 30, "clean")
    assert got[101] == (True, 0, 90, 90, "clean") and got[201] == (False, 94, 94, 0, "substitution_conflict")
    assert got[102][3] == 30 and got[103][3] == 90


def test_extra_time_and_last_entry_wins(spark):
    subs = [{"playerIn": 200, "playerOut": 100, "minute": 50}, {"playerIn": 200, "playerOut": 101, "minute": 70}]
    got = by_player(minutes.lineup_minutes(match(spark, [100, 101], [200], subs, "Penalties")))
    assert got[200] == (False, 70, 120, 50, "clean")


def test_coverage(spark):
    got = {(r.what, r["size"]): r.n for r in minutes.formation_coverage(match(spark, [1, 2], [3])).collect()}
    assert got[("lineup", 2)] == got[("bench", 1)] == got[("substitutions", 0)] == got[("null_substitutions", 1)] == got[("formation", 1)] == 1


def test_interval_union(spark):
    rows = [("a", 0.0, 10.0), ("a", 10.0, 20.0), ("b", 0.0, 10.0), ("b", 5.0, 7.0), ("b", 6.0, 12.0), ("c", 1.0, 1.0), ("d", 0.0, 1.0), ("d", 5.0, 6.0)]
    got = {r.k: (r.covered, r.overlap) for r in minutes.interval_union(spark.createDataFrame(rows, "k string, start double, stop double"), ["k"]).collect()}
    assert got == {"a": (20.0, False), "b": (12.0, True), "d": (2.0, False)}


def test_stints(spark):
    events = spark.createDataFrame([(1, 1, 0, 0, 1, "Half Start"), (1, 1, 0, 0, 2, "Half Start"), (1, 1, 46, 0, 3, "Half End"), (1, 1, 47, 30, 4, "Half End"), (1, 2, 45, 0, 5, "Half Start"), (1, 2, 93, 0, 6, "Half End")], "match_id long, period long, minute long, second long, index long, type_name string")
    bounds = minutes.period_bounds(events)
    stint = "array<struct<`from`:string,from_period:long,`to`:string,to_period:long>>"
    rows = [(1, 7, 10, [("00:00", 1, None, None)]), (1, 7, 11, [("00:00", 1, "60:00", 2), ("50:00", 2, "70:00", 2)]), (1, 7, 12, [])]
    got = {r.player_id: (r.minutes_played, r.derivation_status) for r in minutes.stint_minutes(spark.createDataFrame(rows, f"match_id long, team_id long, player_id long, positions {stint}"), bounds).collect()}
    assert got == {10: (95.5, "clean"), 11: (72.5, "overlap_merged"), 12: (0.0, "clean")}
    with pytest.raises(Exception, match="lacks its start or end"):
        minutes.period_bounds(events.where("index <> 6")).collect()


def split(spark, rows):
    df = spark.createDataFrame(rows, "match_id long, competitionId long, date string")
    return {r.match_id: r.period for r in temporal.assign_periods(df).collect()}


def test_halves(spark):
    assert split(spark, [(1, 1, "2020-01-01"), (2, 1, "2020-01-02"), (3, 1, "2020-01-03")]) == {1: "A", 2: "B", 3: "B"}
    for rows in ([(20, 1, "d"), (30, 1, "d")], [(30, 1, "d"), (20, 1, "d")]):
        assert split(spark, rows) == {20: "A", 30: "B"}
    assert split(spark, [(1, 1, "x"), (2, 2, "x"), (3, 2, "y")]) == {1: "B", 2: "A", 3: "B"}


def test_halves_order_a_date_alone(spark):
    """Unknown scopes and dates have their own place, repeated matches count, and no window orders a scope's matches."""
    import random
    import re

    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.choice([1, 2, None]), rng.choice([None, "a", "b", "c", "d"])) for _ in range(400)] + [(i, 3, "a") for i in range(7)]
    df = spark.createDataFrame(rows, "match_id long, competitionId long, date string")
    out = temporal.assign_periods(df)
    want = []
    for scope in {r[1] for r in rows}:
        held = sorted(((d is not None, d or "", m) for m, s, d in rows if s == scope))
        want += [(m, scope, "A" if i < len(held) // 2 else "B") for i, (_, _, m) in enumerate(held)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert set(re.findall(r"row_number\(\) windowspecdefinition\((\w+)#\w+, (\w+)#\w+, match_id", plan)) == {("competitionId", "date")}


def test_eligibility_and_total_lookup(spark):
    rows = [(1, "A", 100), (1, "B", 100), (2, "A", 100), (2, "B", 10), (3, "A", 100)]
    df = spark.createDataFrame(rows, "player_id long, period string, minutes_played long")
    assert {r.player_id for r in temporal.eligible_in_both(df, ["player_id"], 50).collect()} == {1}
    roles = spark.createDataFrame([(1, "F")], "player_id long, role string")
    assert temporal.attach_total(df.where("player_id = 1"), roles, ["player_id"], "no role").count() == 2
    with pytest.raises(Exception, match="no role"):
        temporal.attach_total(df, roles, ["player_id"], "no role").collect()


def test_season_and_population(spark):
    played = spark.createDataFrame([(1, 1, 90), (1, 2, 30), (2, 1, 0)], "player_id long, match_id long, minutes_played long")
    matches = spark.createDataFrame([(1, 5), (2, 5)], "wyId long, competitionId long")
    season = minutes.season_minutes(played, matches)
    assert [tuple(r) for r in season.collect()] == [(1, 5, 120, 2)]
    got = minutes.population(season, spark.createDataFrame([(1, "F")], "player_id long, role string"), spark.createDataFrame([(5, "L")], "competitionId long, competition string"), 100)
    assert {(r.facet, r.value, r.n_players) for r in got.collect()} == {("all", None, 1), ("competition", "L", 1), ("role", "F", 1)}
    assert got.where(F.col("n_players") > 1).count() == 0


def test_tasks_of_minutes_grow_with_the_rows(spark, monkeypatch):
    played = spark.range(1000).select((F.col("id") % 7).alias("player_id"), (F.col("id") % 90).alias("match_id"), F.lit(1.0).alias("minutes_played"))
    matches = spark.range(90).select(F.col("id").alias("wyId"), (F.col("id") % 3).alias("competitionId"))
    whole = sorted(map(tuple, minutes.season_minutes(played, matches).collect()))
    monkeypatch.setattr(minutes, "ROWS", 100)
    dealt = minutes.season_minutes(played, matches)
    assert "hashpartitioning(match_id" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, dealt.collect())) == whole
