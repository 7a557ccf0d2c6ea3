"""Gates, sampling and the published bundle."""

from __future__ import annotations

import pytest

from spanmill.operators import evidence, facets
from spanmill.plans import decisions, showcase


def test_decisions(spark, tmp_path):
    roles = {"Defender": (95, -0.01), "Goalkeeper": (20, -0.5)}
    good = decisions.clauses(0.05, 0.01, roles, 0.1, -0.005, True)
    assert decisions.keep(good) == "KEEP"
    assert decisions.keep(decisions.clauses(0.05, 0.01, {"Defender": (50, -0.03)}, 0.1, 0.0, True)) == "DROP"
    assert decisions.continuation(0.01, 0.0) and not decisions.continuation(0.009, 0.0)
    assert decisions.budgets([{"seconds": 1, "peak_bytes": 1, "artifact_bytes": 6 << 20}, {"seconds": 2, "peak_bytes": 1, "artifact_bytes": 1}]) == {"seconds": True, "peak_bytes": True, "artifact_bytes": False}
    arms = spark.createDataFrame([(0.1, 0.5), (1.0, 0.5), (2.0, 0.4)], "regularization double, mrr double")
    assert decisions.select_arm(arms).first().regularization == 1.0
    log = tmp_path / "log.md"
    log.write_text("nothing")
    with pytest.raises(PermissionError):
        decisions.assert_registered({"a": 1}, log)
    log.write_text(decisions.protocol_hash({"a": 1}))
    decisions.assert_registered({"a": 1}, log)


def test_by_role_and_failures(spark):
    a = spark.createDataFrame([(1, 2), (2, 4)], "id long, rank int")
    b = spark.createDataFrame([(1, 1), (2, 4)], "id long, rank int")
    role = spark.createDataFrame([(1, "F"), (2, "D")], "id long, role string")
    got = {r.role: (r.delta, r.gates) for r in decisions.by_role(a, b, ["id"], role, 1).collect()}
    assert got == {"F": (0.5, True), "D": (0.0, True)} and decisions.failure_cases(a, ["id"], 1).first().id == 2


def test_sampling(spark):
    rows = [(i, f"r{i % 2}", f"l{i % 3}", i % 20) for i in range(120)]
    got = decisions.sample_queries(spark.createDataFrame(rows, "id long, role string, league string, team long"), ["id"], 4, 1).collect()
    assert len({r.team for r in got}) == len(got) == 8 and {r.role for r in got} == {"r0", "r1"}
    assert all(len({r.league for r in got if r.role == x}) == 3 for x in ("r0", "r1"))


def test_catalog_and_bundle(spark):
    catalog = showcase.feature_catalog(spark)
    rows = {r.feature_id: r for r in catalog.collect()}
    assert len(rows) == 32 and rows["mean_x"].unit == "pitch_percent" and rows["pass_completion_pct"].support == "attempts" and rows["goals_p90"].null_meaning is None
    profiles = spark.createDataFrame([(1, 5), (1, 5), (2, 5)], "player_id long, competitionId long")
    players = spark.createDataFrame([(1, "A", "F"), (2, "B", "F")], "player_id long, name string, role string")
    index = showcase.player_index(profiles, players, spark.createDataFrame([(5, "L")], "competitionId long, competition string"))
    assert sorted(r.profile_key for r in index.collect()) == ["wy-1-c-5", "wy-2-c-5"]
    assert {r.status for r in showcase.validate_identities(index, "name").collect()} == {"ok"}
    values = spark.createDataFrame([("wy-1-c-5", p, "mean_x", v, q) for p, v, q in (("A", 1.0, 10.0), ("B", 2.0, 40.0))], "profile_key string, period string, feature_id string, value double, percentile double")
    row = showcase.fingerprint_rows(values, catalog).first()
    assert row["shift"] == 30.0 and facets.largest_shift(showcase.fingerprint_rows(values, catalog), ["profile_key"], "shift", "feature_id").first().feature_id == "mean_x"


def test_validation_and_drift(spark):
    schema = "profile_key string, rank int, neighbor string, score double, player long, neighbor_player long, role string, neighbor_role string"
    good = [("a", 1, "b", 0.9, 1, 2, "F", "F"), ("a", 2, "c", 0.8, 1, 3, "F", "F")]
    index = spark.createDataFrame([("a",), ("b",), ("c",)], "profile_key string")
    assert {r.status for r in showcase.validate_neighbors(spark.createDataFrame(good, schema), index, k=2).collect()} == {"ok"}
    bad = [("a", 2, "b", 0.9, 1, 1, "F", "D"), ("a", 1, "z", 0.8, 1, 3, "F", "F")]
    failed = {r.check_name for r in showcase.validate_neighbors(spark.createDataFrame(bad, schema), index, k=2).where("status = 'fail'").collect()}
    assert failed == {"ordered by score", "another player", "same role", "foreign_key(neighbor)"}
    values = spark.createDataFrame([(None, 0.0, 50.0, True), (1.0, 0.3, 101.0, True)], "raw_value double, z double, percentile double, imputed boolean")
    assert {r.check_name for r in showcase.validate_values(values).where("status = 'fail'").collect()} == {"range(percentile)", "observed isn't imputed"}
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 3.0)], "k long, x double")
    assert sorted(r.k for r in showcase.drift(a, b, ["k"], ["x"]).collect()) == [2, 3, 4]


def test_changes_between_manifests(spark):
    docs = lambda *r: evidence.manifest(spark.createDataFrame(list(r), "k string, document string"), "k")
    got = {r.change: r.n for r in evidence.change_counts(docs(("a", "1"), ("b", "2"), ("c", "3")), docs(("a", "1"), ("b", "x"), ("d", "3"))).collect()}
    assert got == {"same": 1, "changed": 1, "removed": 1, "added": 1}


def test_teams_and_dates(spark):
    minutes = spark.createDataFrame([(1, 7, 10), (1, 8, 90), (1, 7, 80)], "player_id long, team_id long, minutes_played long")
    assert [t.team_id for t in showcase.team_contexts(minutes, ["player_id"]).first().teams] == [7, 8]
    matches = spark.createDataFrame([(1, "2018-01-02 10:00:00"), (2, "2018-01-01 10:00:00")], "match_id long, date string")
    periods = spark.createDataFrame([(1, 5, "A"), (2, 5, "A")], "match_id long, competitionId long, period string")
    assert tuple(showcase.period_dates(matches, periods).first()) == (5, "A", "2018-01-01", "2018-01-02", 2)
