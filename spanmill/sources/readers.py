"""Readers with explicit schemas for the raw inputs of both providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.text import clean_sentinels

EVENT = (
    "eventId long, subEventName string, tags array<struct<id:long>>, playerId long, positions array<struct<y:long,x:long>>, matchId long, "
    "eventName string, teamId long, matchPeriod string, eventSec double, subEventId string, id long"
)
MATCH = "wyId long, competitionId long, seasonId long, dateutc string, duration string, label string, gameweek long, teamsData string"
PLAYER = "wyId long, shortName string, firstName string, lastName string, currentTeamId string, role struct<name:string,code2:string,code3:string>"
TEAM = "wyId long, name string, city string, officialName string, type string"
COMPETITION = "wyId long, name string, format string, type string"

_NAMED = "struct<id:long,name:string>"
EVENT_2 = (
    f"id string, index long, period long, minute long, second long, type {_NAMED}, player {_NAMED}, team {_NAMED}, position {_NAMED}, location array<double>, "
    f"possession long, possession_team {_NAMED}, under_pressure boolean, "
    f"pass struct<end_location:array<double>,length:double,outcome:{_NAMED},height:{_NAMED},cross:boolean,goal_assist:boolean,shot_assist:boolean,through_ball:boolean>, "
    f"carry struct<end_location:array<double>>, shot struct<end_location:array<double>,outcome:{_NAMED},type:{_NAMED},body_part:{_NAMED},statsbomb_xg:double>, "
    f"duel struct<type:{_NAMED},outcome:{_NAMED}>, dribble struct<outcome:{_NAMED}>, interception struct<outcome:{_NAMED}>"
)
_STINT = "struct<`from`:string,from_period:long,`to`:string,to_period:long>"
LINEUP_2 = f"team_id long, team_name string, lineup array<struct<player_id:long,player_name:string,positions:array<{_STINT}>>>"


def json_array(spark: SparkSession, path: str | Sequence[str], schema: str, source: bool = False) -> DataFrame:
    """Files that each hold one JSON array; ``source`` adds the file's name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.col("_metadata.file_name").alias("_source_file")) if source else df


def events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Events; an empty sub-event id is null."""
    df = clean_sentinels(json_array(spark, path, EVENT, source=True))
    return df.withColumn("subEventId", F.nullif("subEventId", F.lit("")).try_cast("long"))


def matches(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Matches; the object under teamsData is kept as JSON text."""
    return json_array(spark, path, MATCH, source=True)


def records(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return clean_sentinels(json_array(spark, path, schema))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def union_relaxed(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all frames; missing columns are null."""
    out = first
    for df in others:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def flat_events_2(spark: SparkSession, path: str | Sequence[str], match_id: Column, competition_id: Column) -> DataFrame:
    """Nested events of the second provider, flattened."""
    return flatten_events_2(json_array(spark, path, EVENT_2, source=True), match_id, competition_id)


def flatten_events_2(raw: DataFrame, match_id: Column, competition_id: Column) -> DataFrame:
    """One row per event.  Flags of a pass are false unless said, and null on other events."""
    c = F.col
    end = F.coalesce(c("pass.end_location"), c("carry.end_location"), c("shot.end_location"))
    flag = lambda x: F.when(c("pass").isNotNull(), F.coalesce(c(x), F.lit(False)))
    return raw.select(
        c("id").alias("event_id"), match_id.alias("match_id"), competition_id.alias("competitionId"), "index", "period", "minute", "second",
        c("type.name").alias("type_name"), c("player.id").alias("player_id"), c("player.name").alias("player_name"), c("team.id").alias("team_id"), c("team.name").alias("team_name"),
        c("position.id").alias("position_id"), c("position.name").alias("position_name"), "possession", c("possession_team.id").alias("possession_team_id"),
        F.get("location", 0).alias("location_x"), F.get("location", 1).alias("location_y"), F.get(end, 0).alias("end_location_x"), F.get(end, 1).alias("end_location_y"),
        c("pass.length").alias("pass_length"), c("pass.outcome.name").alias("pass_outcome_name"), c("pass.height.name").alias("pass_height_name"),
        flag("pass.cross").alias("pass_cross"), flag("pass.goal_assist").alias("pass_goal_assist"), flag("pass.shot_assist").alias("pass_shot_assist"), flag("pass.through_ball").alias("pass_through_ball"),
        c("shot.outcome.name").alias("shot_outcome_name"), c("shot.type.name").alias("shot_type_name"), c("duel.type.name").alias("duel_type_name"), c("duel.outcome.name").alias("duel_outcome_name"),
        c("dribble.outcome.name").alias("dribble_outcome_name"), c("shot.statsbomb_xg").alias("shot_statsbomb_xg"), c("shot.body_part.name").alias("shot_body_part_name"),
        c("interception.outcome.name").alias("interception_outcome_name"),
    )


def squads_2(lineups: DataFrame, teams: DataFrame, match_id: Column) -> DataFrame:
    """(match_id, team_id, player_id, player_name, positions); line-ups name teams, ``teams``
    (team_name, team_id) gives their ids."""
    rows = lineups.select("team_name", F.explode("lineup").alias("p")).join(teams.select("team_name", F.col("team_id")).distinct(), "team_name")
    return rows.select(match_id.alias("match_id"), "team_id", "p.player_id", "p.player_name", F.coalesce("p.positions", F.array().cast(f"array<{_STINT}>")).alias("positions"))


def roster(squads: DataFrame, competition_id: Column) -> DataFrame:
    """One row per player and competition, with the smallest name where there are several."""
    return squads.groupBy("player_id", competition_id.alias("competitionId")).agg(F.min("player_name").alias("player_name"))


def roles_from_positions(flat: DataFrame) -> DataFrame:
    """(player_id, role) from the most frequent position (ties: the first name)."""
    counts = flat.where("player_id is not null and position_name is not null").groupBy("player_id", "position_name").agg(F.count("*").alias("n"))
    modal = counts.groupBy("player_id").agg(F.min_by("position_name", F.struct(-F.col("n"), F.col("position_name"))).alias("position"))
    p = F.col("position")
    role = F.when(F.contains(p, F.lit("Goalkeeper")), "Goalkeeper").when(F.contains(p, F.lit("Back")), "Defender").when(F.contains(p, F.lit("Midfield")), "Midfielder").otherwise("Forward")
    return modal.select("player_id", role.alias("role"))
