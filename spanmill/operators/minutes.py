"""Minutes on the pitch, from line-ups or from stints, and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.numeric import distinct_with_null
from spanmill.functions.text import card_minute, clock_minutes

#: Rows of a task, about, where the session's shuffle partitions would hold more.
ROWS = 300_000

PLAYER = "struct<playerId:long,ownGoals:string,redCards:string,goals:string,yellowCards:string>"
FORMATION = f"struct<lineup:array<{PLAYER}>,bench:array<{PLAYER}>,substitutions:string>"
TEAMS = f"map<string,struct<hasFormation:int,formation:{FORMATION}>>"
SUBSTITUTIONS = "array<struct<playerIn:long,playerOut:long,minute:int>>"


def _tasks(rows: DataFrame) -> int | None:
    """Partitions that ``rows`` need beyond the session's, so that a task holds no more when they grow."""
    tasks = -(-rows.count() // ROWS)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return rows.repartition(tasks, *keys) if tasks else rows


def formations(matches: DataFrame) -> DataFrame:
    """A row per match and team of the JSON in ``teamsData``; substitutions may be a text ``null``."""
    teams = F.from_json("teamsData", TEAMS)
    rows = matches.select("wyId", "competitionId", "duration", F.explode(teams).alias("team", "entry"))
    form = F.col("entry.formation")
    return rows.select(
        F.col("wyId").alias("match_id"), "competitionId", "duration", F.col("team").cast("long").alias("team_id"), F.col("entry.hasFormation").alias("has_formation"),
        F.coalesce(form["lineup"], F.array().cast(f"array<{PLAYER}>")).alias("lineup"),
        F.coalesce(form["bench"], F.array().cast(f"array<{PLAYER}>")).alias("bench"),
        F.coalesce(F.from_json(F.nullif(form["substitutions"], F.lit("null")), SUBSTITUTIONS), F.array().cast(SUBSTITUTIONS)).alias("subs"),
        (form["substitutions"] == "null").alias("null_subs"),
    )


def formation_coverage(matches: DataFrame) -> DataFrame:
    """(what, size, n): sizes of line-ups, benches and substitution lists, whether a team has
    a formation, and how many substitution lists are the text ``null``."""
    teams = formations(matches)
    named = F.explode(
        F.array(
            *(F.struct(F.lit(k).alias("what"), v.cast("long").alias("size")) for k, v in (
                ("formation", F.coalesce(F.col("has_formation"), F.lit(0))), ("lineup", F.size("lineup")), ("bench", F.size("bench")),
                ("substitutions", F.size("subs")), ("null_substitutions", F.coalesce(F.col("null_subs"), F.lit(False)).cast("int")),
            ))
        )
    ).alias("x")
    return teams.select(named).groupBy("x.what", "x.size").agg(F.count("*").alias("n"))


def _last(subs: Column, who: str, player: Column) -> Column:
    """Minute of the player's last entry in the list, null without one."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(subs, lambda s: s[who] == player), lambda s: s["minute"])), -1)


def lineup_minutes(matches: DataFrame) -> DataFrame:
    """(player_id, match_id, team_id, started, minute_in, minute_out, minutes_played,
    derivation_status) of everyone in a squad.

    A player leaves at the end, when substituted or when sent off, whichever is
    first.  Leaving before entering gives 0 minutes and
    ``substitution_conflict``; more than the duration and 30 is ``invalid``."""
    teams = formations(matches)

    def squad(column: str, started: bool) -> Column:
        return F.transform(column, lambda p: F.struct(p.alias("p"), F.lit(started).alias("started")))

    listed = F.explode(F.concat(squad("lineup", True), squad("bench", False))).alias("x")
    rows = teams.select("match_id", "team_id", "duration", "subs", listed)
    full = F.when(F.col("duration").isin("ExtraTime", "Penalties"), 120).otherwise(90)
    player = F.col("x.p.playerId")
    rows = rows.select(
        player.alias("player_id"), "match_id", "team_id", F.col("x.started").alias("started"), full.alias("_full"),
        F.when(F.col("x.started"), F.lit(0)).otherwise(_last(F.col("subs"), "playerIn", player)).alias("minute_in"),
        F.least(full, _last(F.col("subs"), "playerOut", player), card_minute(F.col("x.p.redCards"))).alias("_leaves"),
    )
    unused, clash = F.col("minute_in").isNull(), F.col("_leaves") < F.col("minute_in")
    stay = F.col("_leaves") - F.col("minute_in")
    return rows.select(
        "player_id", "match_id", "team_id", "started", "minute_in",
        F.when(~unused, F.greatest("_leaves", "minute_in")).alias("minute_out"),
        F.when(unused | clash, F.lit(0)).otherwise(stay).alias("minutes_played"),
        F.when(clash, "substitution_conflict").when(stay > F.col("_full") + 30, "invalid").otherwise("clean").alias("derivation_status"),
    )


def interval_union(segments: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """(keys, covered, overlap): the length that a key's segments cover together, and whether
    any two overlap; touching ends don't.  Empty segments are ignored."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.where(F.col(stop) > F.col(start)).withColumn("_reach", reach)
    fresh = F.greatest(F.col(stop) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))), F.lit(0.0))
    return marked.groupBy(*keys).agg(F.sum(fresh).alias("covered"), F.bool_or(F.coalesce(F.col(start) < F.col("_reach"), F.lit(False))).alias("overlap"))


def period_bounds(events: DataFrame) -> DataFrame:
    """(match_id, period, start, stop) in minutes: the first start by event order and the last
    end; a period with only one of them is an error."""
    clock = F.col("minute") + F.col("second") / 60.0
    begins, ends = F.col("type_name") == "Half Start", F.col("type_name") == "Half End"
    bounds = events.where(begins | ends).groupBy("match_id", "period").agg(F.min_by(F.when(begins, clock), F.when(begins, F.col("index"))).alias("start"), F.max(F.when(ends, clock)).alias("stop"))
    broken = F.col("start").isNull() | F.col("stop").isNull()
    return bounds.withColumn("start", F.when(broken, F.raise_error(F.lit("a period lacks its start or end")).cast("double")).otherwise(F.col("start")))


def stint_minutes(squads: DataFrame, bounds: DataFrame) -> DataFrame:
    """(player_id, match_id, team_id, minutes_played, derivation_status) from squads
    (match_id, team_id, player_id, positions array of from, from_period, to,
    to_period): the union of each period's stints, clipped to the period."""
    tasks = _tasks(squads)
    squads, bounds = (_dealt(x, tasks, "match_id") for x in (squads, bounds))
    last = bounds.groupBy("match_id").agg(F.max("period").alias("_last"), F.max_by("stop", "period").alias("_whistle"))
    keys = ["player_id", "match_id", "team_id"]
    stints = squads.select(*keys, F.explode("positions").alias("s")).join(last, "match_id", "left")
    open_end = F.col("s.to").isNull()
    stints = stints.select(
        *keys, clock_minutes(F.col("s.from")).alias("_from"), F.col("s.from_period").alias("_p1"),
        F.when(open_end, F.col("_whistle")).otherwise(clock_minutes(F.col("s.to"))).alias("_to"), F.when(open_end, F.col("_last")).otherwise(F.col("s.to_period")).alias("_p2"),
    )
    within = stints.join(bounds, "match_id").where(F.col("period").between(F.col("_p1"), F.col("_p2")))
    begin = F.greatest(F.when(F.col("period") == F.col("_p1"), F.col("_from")), F.col("start"))
    end = F.least(F.when(F.col("period") == F.col("_p2"), F.col("_to")), F.col("stop"))
    per_period = interval_union(within.select(*keys, "period", begin.alias("start"), end.alias("stop")), [*keys, "period"])
    covered = per_period.groupBy(*keys).agg(F.sum("covered").alias("covered"), F.bool_or("overlap").alias("overlap"))
    whole, covered = (_dealt(x, tasks, *keys) for x in (squads.select(*keys), covered))
    whole = whole.distinct().join(covered, keys, "left")
    status = F.when(F.col("overlap"), "overlap_merged").otherwise("clean")
    return whole.select(*keys, F.round(F.coalesce("covered", F.lit(0.0)), 3).alias("minutes_played"), status.alias("derivation_status"))


def season_minutes(minutes: DataFrame, matches: DataFrame) -> DataFrame:
    """(player_id, competitionId, minutes_played, matches_appeared) of players with minutes."""
    tasks = _tasks(minutes)
    named = matches.select(F.col("wyId").alias("match_id"), "competitionId")
    scoped = _dealt(minutes, tasks, "match_id").join(_dealt(named, tasks, "match_id"), "match_id", "left")
    return scoped.where("minutes_played > 0").groupBy("player_id", "competitionId").agg(F.sum("minutes_played").alias("minutes_played"), F.count_distinct("match_id").alias("matches_appeared"))


def population(season: DataFrame, players: DataFrame, competitions: DataFrame, threshold: float) -> DataFrame:
    """(facet, value, n_players): players at the threshold, in all, by competition and by role."""
    enough = season.where(F.col("minutes_played") >= threshold)
    named = enough.join(competitions, "competitionId", "left").join(players, "player_id", "left")
    facet = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(c).cast("string").alias("value")) for k, c in (("competition", "competition"), ("role", "role")))))
    parts = named.select("player_id", facet.alias("x")).groupBy("x.facet", "x.value").agg(F.count_distinct("player_id").alias("n_players"))
    whole = named.agg(distinct_with_null(F.col("player_id")).alias("n_players")).select(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value"), "n_players")
    return whole.unionByName(parts)
