"""Quality checks, readers, sinks, search, streaming, and every query against its SQL."""

from __future__ import annotations

import json

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from spanmill.functions import text
from spanmill.operators import facets, quality
from spanmill.plans import uncertainty
from spanmill.queries import ORACLE_SQL, QUERIES
from spanmill.sources import readers, sinks
from spanmill.streaming import events as streaming


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, None, 5.0), (None, "", 0.0)], "k long, s string, x double")
    got = {r.check_name: (r.n_bad, r.status) for r in quality.run_checks(df, [quality.unique_key("k"), *quality.required("k", "s"), quality.no_negative("x"), quality.in_range("x", 0, 4), quality.at_least_rows(4), quality.sentinel_zero("x"), quality.two_nulls("s"), quality.rare_flag(F.col("x") > 4, "big")]).collect()}
    assert got == {"unique(k)": (1, "fail"), "not_null(k)": (1, "fail"), "not_null(s)": (1, "fail"), "no_negative(x)": (1, "fail"), "range(x)": (2, "fail"), "rows>=4": (1, "fail"), "zero_sentinel(x)": (1, "warn"), "two_nulls(s)": (2, "warn"), "rare(big)": (1, "warn")}
    results = quality.suite([quality.run_checks(df, [quality.unique_key("k"), quality.at_least_rows(1)])])
    assert {r.status: r.n for r in quality.summary(results).collect()} == {"fail": 1, "ok": 1} and "| unique(k) | 3 | 1 | fail |" in quality.report(results)
    assert quality.missing_columns(df, ["k", "z"]) == ["z"]


def test_orphans_and_bounds(spark):
    child = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "p long")
    r = quality.orphans(child, "k", parent, "p", "x", sentinels=[0]).first()
    assert (r.n_checked, r.n_bad, r.status, r.samples) == (3, 2, "fail", [2, 3])
    events = spark.createDataFrame([([(0, 101), (50, None)],), ([],)], "positions array<struct<x:long,y:long>>")
    got = {r.axis: (r.n_checked, r.n_bad, r.percent_bad) for r in quality.coordinate_bounds(events).collect()}
    assert got == {"x": (2, 0, 0.0), "y": (1, 1, 100.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "events_X.json").write_text(json.dumps([{"id": 1, "subEventId": "", "eventSec": 2, "eventName": "null", "tags": [{"id": 5}], "positions": [{"x": 1, "y": 2}], "playerId": 3, "matchId": 4}]))
    r = readers.events(spark, str(tmp_path / "events_X.json")).first()
    assert r.subEventId is None and r.eventSec == 2.0 and r.eventName is None and r._source_file == "events_X.json" and r.tags[0].id == 5
    (tmp_path / "matches.json").write_text(json.dumps([{"wyId": 1, "teamsData": {"7": {"hasFormation": 1}}}]))
    assert json.loads(readers.matches(spark, str(tmp_path / "matches.json")).first().teamsData) == {"7": {"hasFormation": 1}}
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert readers.csv_table(spark, str(tmp_path / "t.csv"), "a long, b string").first() == (1, "x")
    (tmp_path / "e2.json").write_text(json.dumps([{"id": "u", "index": 1, "period": 1, "minute": 0, "second": 1, "type": {"id": 30, "name": "Pass"}, "player": {"id": 9, "name": "P"}, "team": {"id": 7, "name": "T"}, "position": {"id": 1, "name": "Right Back"}, "location": [60.0, 40.0], "pass": {"end_location": [90.0, 40.0], "length": 30.0, "cross": True}}]))
    flat = readers.flat_events_2(spark, str(tmp_path / "e2.json"), F.lit(1), F.lit(2))
    r = flat.first()
    assert (r.type_name, r.location_x, r.end_location_x, r.pass_cross, r.pass_goal_assist, r.shot_outcome_name) == ("Pass", 60.0, 90.0, True, False, None)
    assert readers.roles_from_positions(flat).first().role == "Defender"
    (tmp_path / "l.json").write_text(json.dumps([{"team_name": "T", "lineup": [{"player_id": 9, "player_name": "P", "positions": [{"from": "00:00", "from_period": 1, "to": None, "to_period": None}]}]}]))
    squads = readers.squads_2(readers.json_array(spark, str(tmp_path / "l.json"), readers.LINEUP_2).drop("team_id"), flat.select("team_name", "team_id"), F.lit(1))
    assert squads.first().team_id == 7 and readers.roster(squads, F.lit(2)).first().player_name == "P"
    a, b = spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([("x",)], "b string")
    assert readers.union_relaxed(a, b).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("replicate"), "id")
    path = str(tmp_path / "chunks")
    assert sinks.pending_replicates(spark, path, 3, 3).count() == 3
    sinks.append_replicates(df, path)
    assert [r.replicate for r in sinks.pending_replicates(spark, path, 3, 3).collect()] == [2]
    with pytest.raises(Exception, match="another number"):
        sinks.pending_replicates(spark, path, 3, 4).collect()
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'.encode()
    with pytest.raises(ValueError):
        sinks.canonical_json({"a": [float("nan")]})
    sinks.publish({"x/y.json": b"1"}, tmp_path / "out")
    sinks.publish({"z.json": b"2"}, tmp_path / "out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["z.json"]
    digests = {"z.json": __import__("hashlib").sha256(b"2").hexdigest()}
    one = sinks.pack_archive({"z.json": b"2"}, tmp_path / "a.tgz")
    assert one == sinks.pack_archive({"z.json": b"2"}, tmp_path / "b.tgz") and sinks.unpack_archive(tmp_path / "a.tgz", one, digests) == {"z.json": b"2"}
    with pytest.raises(ValueError):
        sinks.unpack_archive(tmp_path / "a.tgz", one, {})
    sinks.same_manifest(tmp_path / "m.json", {"a": 1})
    with pytest.raises(ValueError):
        sinks.same_manifest(tmp_path / "m.json", {"a": 2})
    (tmp_path / "c.json").write_text('{"a": 1}')
    with pytest.raises(KeyError):
        sinks.load_config(tmp_path / "c.json", ["a", "b"])
    assert sinks.verify_md5(spark, str(tmp_path / "c.json"), {"c.json": __import__("hashlib").md5(b'{"a": 1}').hexdigest(), "d": "x"}) == ["d"]


def test_text_and_facets(spark):
    df = spark.createDataFrame([("José \\u00c1lvarez", "45:30", "0"), ("null", None, "null")], "n string, c string, m string")
    r = df.select(text.search_text(F.col("n")).alias("s"), text.decode_escapes(F.col("n")).alias("d"), text.has_escape(F.col("n")).alias("e"), text.clock_minutes(F.col("c")).alias("c"), text.card_minute(F.col("m")).alias("m")).collect()
    assert r[0].s == "jose \\u00c1lvarez" and r[0].d == "José Álvarez" and r[0].e and r[0].c == 45.5 and r[0].m is r[1].m is r[1].c is None
    assert text.clean_sentinels(df).collect()[1].n is None
    assert facets.search(df, F.lower("n"), "jos", {"m": "0"}).count() == 1
    assert facets.first_of(spark.createDataFrame([([1, 2, 3],)], "x array<int>"), "x", 2).first().x == [1, 2]
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22")), ("z", bytearray(b""))], "path string, content binary")
    sha = F.sha2(F.lit("1").cast("binary"), 256)
    manifest = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, bytes long").withColumn("sha256", sha)
    assert {r.path: r.status for r in facets.verified(files, manifest).collect()} == {"a": "ok", "b": "size", "c": "missing", "z": "undeclared"}


def test_streaming_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_activity(streaming.read_events(spark, str(tmp_path / "in"), 1), late="400 days")
    streaming.run_to_table(stream, "activity", str(tmp_path / "cp"))
    live = {(r.window_start, r.event_type): r.n for r in spark.table("activity").collect()}
    batch = {(r.window_start, r.event_type): r.n for r in streaming.windowed_activity(source).collect()}
    assert live == batch and sum(live.values()) == 1000
    assert streaming.sessions(source).agg(F.sum("n")).first()[0] == 1000


def test_replicates_by_numpy(spark):
    sums = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 6.0)], "player_id long, match_id long, x double")
    plan = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (1, 2, 1)], "replicate int, match_id long, multiplicity long")
    got = uncertainty.replicate_profiles(sums, plan, ["player_id"], ["x"])
    assert {(r.replicate, r.player_id): r.x for r in got.collect()} == {(0, 1): 4.0, (0, 2): 12.0, (1, 1): 6.0, (1, 2): 6.0}
    z = {(r.replicate, r.player_id): r.x for r in uncertainty.standardize_replicates(got, ["x"]).collect()}
    assert z[(0, 1)] == pytest.approx(-z[(0, 2)]) and z[(1, 1)] == z[(1, 2)] == 0.0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in ORACLE_SQL:
        same_rows(df, duck, ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_a_replicate_that_is_there_is_refused(spark, tmp_path):
    from spanmill.sources import sinks

    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "replicate int, v double")
    sinks.append_replicates(rows, str(tmp_path / "chunks"))
    with pytest.raises(FileExistsError, match="replicate 1"):
        sinks.append_replicates(rows.where("replicate = 1"), str(tmp_path / "chunks"))
    sinks.append_replicates(rows.where("replicate = 1").selectExpr("2 as replicate", "v"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 3


def test_flags_of_a_pass_are_null_on_other_events(spark, tmp_path):
    import json

    from spanmill.sources import readers

    raw = [{"id": "a", "type": {"name": "Pass"}, "pass": {"cross": True}}, {"id": "b", "type": {"name": "Shot"}, "shot": {"statsbomb_xg": 0.25, "body_part": {"name": "Head"}}}, {"id": "c", "type": {"name": "Interception"}, "interception": {"outcome": {"name": "Won"}}}]
    (tmp_path / "e.json").write_text(json.dumps(raw))
    got = {r.event_id: r for r in readers.flat_events_2(spark, str(tmp_path / "e.json"), F.lit(1), F.lit(2)).collect()}
    assert (got["a"].pass_cross, got["a"].pass_goal_assist, got["b"].pass_cross) == (True, False, None)
    assert (got["b"].shot_statsbomb_xg, got["b"].shot_body_part_name, got["c"].interception_outcome_name) == (0.25, "Head", "Won")
