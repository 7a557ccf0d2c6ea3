"""Feature definitions of both providers on hand-made events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanmill.operators import features

EVENT = "playerId long, matchId long, eventName string, subEventName string, tags array<struct<id:long>>, positions array<struct<x:long,y:long>>"


def flagged(spark, rows):
    events = spark.createDataFrame([(r[0], r[1], r[2], r[3], [(t,) for t in r[4]], r[5]) for r in rows], EVENT)
    return features.with_flags(events).withColumnsRenamed({"playerId": "player_id", "matchId": "match_id"})


def test_tags_are_compiled(spark):
    """Unknown tags and tag lists, and no step that is interpreted row by row."""
    from spanmill.functions.arrays import has_any_tag

    df = spark.createDataFrame([(1, [(101,), (5,)]), (2, [(5,), (None,)]), (3, []), (4, None), (5, [(301,), (None,)]), (6, [(5,)])], "id long, tags array<struct<id:long>>")
    out = df.select("id", has_any_tag(F.col("tags"), [101, 301]).alias("x"))
    assert {r.id: r.x for r in out.collect()} == {1: True, 2: None, 3: False, 4: None, 5: True, 6: False}
    assert "lambdafunction" not in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")


def minutes(spark, *rows):
    return spark.createDataFrame(list(rows), "player_id long, minutes_played long")


def one(spark, rows, m=90):
    return features.player_features(flagged(spark, rows), minutes(spark, (1, m)), ["player_id"]).first()


def test_pass_completion_and_progress(spark):
    rows = [(1, 1, "Pass", "Simple pass", [1801], [(10, 50), (30, 50)]), (1, 1, "Pass", "Simple pass", [1801], [(10, 50), (15, 50)]), (1, 1, "Pass", "Simple pass", [1802], [(50, 50), (20, 50)])]
    r = one(spark, rows)
    assert r.passes_p90 == 3.0 and r.pass_completion_pct == pytest.approx(2 / 3)
    assert r.progressive_pass_distance_p90 == 25.0 and r.progressive_passes_p90 == 1.0 and r.events_p90 == 3.0


def test_goals_of_scorers_only(spark):
    rows = [(1, 1, "Shot", "Shot", [101, 1201], [(90, 50)]), (1, 1, "Free Kick", "Penalty", [101], [(90, 50)]), (1, 1, "Save attempt", "Reflexes", [101], [(5, 50)])]
    r = one(spark, rows)
    assert r.goals_p90 == 2.0 and r.shots_p90 == 1.0 and r.shot_conversion_pct == 1.0 and r.shots_on_target_pct == 1.0


def test_duels_take_ons_and_carries(spark):
    rows = [
        (1, 1, "Duel", "Ground attacking duel", [503, 703], [(50, 50)]), (1, 1, "Duel", "Ground attacking duel", [504, 701], [(50, 50)]),
        (1, 1, "Duel", "Ground defending duel", [703], [(20, 50)]), (1, 1, "Others on the ball", "Acceleration", [], [(50, 50), (40, 50)]),
    ]
    r = one(spark, rows)
    assert r.take_on_success_pct == 0.5 and r.duel_win_pct == pytest.approx(2 / 3) and r.defensive_duel_win_pct == 1.0
    assert r.carry_distance_proxy_p90 == -10.0 and r.carry_proxy_p90 == 1.0


def test_thirds_and_missing_origin(spark):
    rows = [(1, 1, "Touch", "Touch", [], [(33, 10)]), (1, 1, "Touch", "Touch", [], [(34, 20)]), (1, 1, "Touch", "Touch", [], [(67, 30)]), (1, 1, "Touch", "Touch", [], [])]
    r = one(spark, rows)
    assert r.defensive_third_share == r.middle_third_share == r.attacking_third_share == pytest.approx(1 / 3) and r.mean_y == 20.0


def test_player_without_events_and_without_minutes(spark):
    out = features.player_features(flagged(spark, [(1, 1, "Pass", "x", [1801], [(1, 1), (2, 2)])]), minutes(spark, (1, 0), (2, 90)), ["player_id"]).orderBy("player_id").collect()
    assert out[0].passes_p90 is None and out[0].pass_completion_pct == 1.0
    assert out[1].passes_p90 == 0.0 and out[1].events_p90 == 0.0 and out[1].pass_completion_pct is None and out[1].mean_x is None


def test_catalog_and_families():
    assert len(features.FEATURES) == 32 and len(features.FEATURES_2) == 30
    listed = [f for fs in features.FAMILIES.values() for f in fs]
    assert sorted(listed) == sorted(features.FEATURES) and len(features.FAMILIES) == 8


def test_weighted_equals_repeated_rows(spark):
    rows = [(1, m, "Pass", "Cross", [1801 + m % 2], [(10 * m, 20), (10 * m + 20, 30)]) for m in (1, 2, 2)] + [(1, 2, "Shot", "Shot", [101], [(80, 40)])]
    player_match = spark.createDataFrame([(1, 1, 45), (1, 2, 90)], "player_id long, match_id long, minutes_played long")
    stats = features.player_match_statistics(flagged(spark, rows), player_match)
    weights = spark.createDataFrame([(1, 2), (2, 1)], "match_id long, multiplicity long")
    got = features.weighted_features(stats, weights, ["player_id"]).first()
    repeated = flagged(spark, [r for r in rows if r[1] == 1] * 2 + [r for r in rows if r[1] == 2])
    want = features.player_features(repeated, minutes(spark, (1, 180)), ["player_id"]).first()
    for f in features.FEATURES:
        assert got[f] == (pytest.approx(want[f], abs=1e-12) if want[f] is not None else None), f


@pytest.mark.parametrize("bad", [[(1, 0)], [(1, None)], [(1, 1), (1, 2)]])
def test_bad_weights_fail(spark, bad):
    stats = features.player_match_statistics(flagged(spark, [(1, 1, "Pass", "x", [], [])]), spark.createDataFrame([(1, 1, 90)], "player_id long, match_id long, minutes_played long"))
    with pytest.raises(Exception, match="match weights"):
        features.weighted_features(stats, spark.createDataFrame(bad, "match_id long, multiplicity long"), ["player_id"]).collect()


def test_second_provider(spark):
    base = dict.fromkeys("location_x location_y end_location_x end_location_y pass_length pass_outcome_name pass_height_name shot_outcome_name shot_type_name duel_type_name duel_outcome_name dribble_outcome_name".split())
    flags = dict.fromkeys(("pass_cross", "pass_goal_assist", "pass_shot_assist", "pass_through_ball"), False)
    make = lambda **k: base | flags | {"player_id": 1} | k
    rows = [
        make(type_name="Pass", location_x=60.0, location_y=40.0, end_location_x=108.0, end_location_y=40.0, pass_height_name="High Pass", pass_length=48.0),
        make(type_name="Pass", pass_outcome_name="Out", location_x=60.0, location_y=40.0, end_location_x=30.0, end_location_y=40.0),
        make(type_name="Pass", pass_outcome_name="Unknown"),
        make(type_name="Shot", shot_type_name="Open Play", shot_outcome_name="Goal"), make(type_name="Shot", shot_type_name="Penalty", shot_outcome_name="Goal"),
        make(type_name="Duel", duel_type_name="Tackle", duel_outcome_name="Won"), make(type_name="Duel", duel_type_name="Aerial Lost"),
        make(type_name="Carry", location_x=60.0, location_y=1.0, end_location_x=48.0, end_location_y=1.0), make(type_name="Dribble", dribble_outcome_name="Complete"),
    ]
    schema = "player_id long, type_name string, " + ", ".join(f"{k} double" for k in base if "location" in k or k == "pass_length") + ", " + ", ".join(f"{k} string" for k in base if "name" in k) + ", " + ", ".join(f"{k} boolean" for k in flags)
    names = [p.split()[0] for p in schema.split(", ")]
    events = features.with_flags_2(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))
    r = features.player_features(events, minutes(spark, (1, 90)), ["player_id"], features.FEATURES_2).first()
    assert r.pass_completion_pct == 0.5 and r.long_balls_p90 == 1.0 and r.box_entries_p90 == 1.0 and r.progressive_pass_distance_p90 == pytest.approx(40.0)
    assert r.shots_p90 == r.goals_p90 == 1.0 and r.duel_win_pct == 0.5 and r.defensive_duel_win_pct == 1.0
    assert r.carry_distance_proxy_p90 == 0.0 and r.take_on_success_pct == 1.0 and "events_p90" not in r.asDict()


def test_null_tags_stay_unknown(spark):
    events = spark.createDataFrame([(1, 1, "Pass", "x", None, None)], EVENT)
    row = features.with_flags(events).select("is_pass", "pass_accurate", "origin_x", F.col("pass_progress")).first()
    assert row.is_pass and row.pass_accurate is None and row.origin_x is None and row.pass_progress == 0.0
