"""Event flags and per-profile features of both event providers.

Counts of a profile with minutes but no events are 0, ratios and means null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.arrays import has_any_tag, point
from spanmill.functions.numeric import flag_sum, floored, per_90, rescale, safe_ratio, share, total

# Tag ids of the first provider.
TAGS = {"goal": [101], "assist": [301], "key_pass": [302], "take_on": [503, 504], "lost": [701], "won": [703], "through": [901]}
TAGS |= {"goal_zone": [1201, 1202, 1203, 1204, 1205, 1206, 1207, 1208, 1209], "interception": [1401], "sliding_tackle": [1601]}
TAGS |= {"accurate": [1801], "not_accurate": [1802], "blocked": [2101]}
SCORING_SET_PIECES = ["Free kick shot", "Penalty", "Corner"]
# Outcome names of the second provider.
PASS_FAILED = ["Incomplete", "Out", "Pass Offside"]
SHOT_ON_TARGET = ["Goal", "Saved", "Saved To Post", "Saved Off Target"]
TACKLE_WON = DUEL_WON = ["Won", "Success In Play", "Success Out"]
TACKLE_LOST = DUEL_LOST = ["Lost In Play", "Lost Out"]
PROGRESSIVE, BOX_X, BOX_Y = 15, 84, (19, 81)

#: feature -> (kind, columns): rate per 90, ratio, or mean of a statistic
FEATURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "events_p90": ("rate", ("n_events",)),
    "passes_p90": ("rate", ("is_pass",)),
    "pass_completion_pct": ("ratio", ("pass_accurate", "pass_accurate+pass_not_accurate")),
    "crosses_p90": ("rate", ("is_cross",)),
    "long_balls_p90": ("rate", ("is_long_ball",)),
    "smart_passes_p90": ("rate", ("is_smart_pass",)),
    "progressive_pass_distance_p90": ("rate", ("pass_progress",)),
    "progressive_passes_p90": ("rate", ("is_progressive_pass",)),
    "assists_p90": ("rate", ("is_assist",)),
    "key_passes_p90": ("rate", ("is_key_pass",)),
    "through_balls_p90": ("rate", ("is_through_ball",)),
    "box_entries_p90": ("rate", ("is_box_entry",)),
    "shots_p90": ("rate", ("is_shot",)),
    "goals_p90": ("rate", ("scorer_goal",)),
    "shot_conversion_pct": ("ratio", ("shot_goal", "is_shot")),
    "shots_on_target_pct": ("ratio", ("shot_on_target", "is_shot")),
    "blocked_shot_pct": ("ratio", ("shot_blocked", "is_shot")),
    "interceptions_p90": ("rate", ("is_interception",)),
    "sliding_tackles_p90": ("rate", ("is_sliding_tackle",)),
    "clearances_p90": ("rate", ("is_clearance",)),
    "defensive_duel_win_pct": ("ratio", ("def_duel_won", "def_duel_decided")),
    "mean_x": ("mean", ("origin_x",)),
    "mean_y": ("mean", ("origin_y",)),
    "defensive_third_share": ("mean", ("in_defensive_third",)),
    "middle_third_share": ("mean", ("in_middle_third",)),
    "attacking_third_share": ("mean", ("in_attacking_third",)),
    "touches_p90": ("rate", ("is_touch",)),
    "duels_p90": ("rate", ("is_duel",)),
    "duel_win_pct": ("ratio", ("duel_won", "duel_decided")),
    "carry_proxy_p90": ("rate", ("is_carry",)),
    "carry_distance_proxy_p90": ("rate", ("carry_distance",)),
    "take_on_success_pct": ("ratio", ("take_on_success", "take_on_attempt")),
}
#: The second provider has no count of all events and no smart passes.
FEATURES_2 = {k: v for k, v in FEATURES.items() if k not in ("events_p90", "smart_passes_p90")}
MEASURES = ("pass_progress", "carry_distance")
MEANS = tuple(c for kind, cs in FEATURES.values() if kind == "mean" for c in cs)
SUMS = tuple(dict.fromkeys(x for kind, cs in FEATURES.values() if kind != "mean" for c in cs for x in c.split("+") if x != "n_events"))
#: feature families, in catalog order
FAMILIES: dict[str, tuple[str, ...]] = {
    "passing": ("passes_p90", "pass_completion_pct", "crosses_p90", "long_balls_p90", "smart_passes_p90"),
    "progression": ("progressive_pass_distance_p90", "progressive_passes_p90"),
    "chance_creation": ("assists_p90", "key_passes_p90", "through_balls_p90", "box_entries_p90"),
    "shooting": ("shots_p90", "goals_p90", "shot_conversion_pct", "shots_on_target_pct", "blocked_shot_pct"),
    "defensive": ("interceptions_p90", "sliding_tackles_p90", "clearances_p90", "defensive_duel_win_pct"),
    "spatial": ("mean_x", "mean_y", "defensive_third_share", "middle_third_share", "attacking_third_share"),
    "possession": ("events_p90", "touches_p90", "duels_p90", "duel_win_pct"),
    "carrying_proxy": ("carry_proxy_p90", "carry_distance_proxy_p90", "take_on_success_pct"),
}
RATIOS = {f: cs for f, (kind, cs) in FEATURES.items() if kind == "ratio"}


def with_flags(events: DataFrame) -> DataFrame:
    """Flags and measures of the first provider's events (eventName, subEventName, tags, positions)."""
    name, sub, tags, pos = F.col("eventName"), F.col("subEventName"), F.col("tags"), F.col("positions")
    tag = {k: has_any_tag(tags, ids) for k, ids in TAGS.items()}
    ox, oy, dx, dy = point(pos, 0, "x"), point(pos, 0, "y"), point(pos, 1, "x"), point(pos, 1, "y")
    forward = F.coalesce(dx - ox, F.lit(0))
    a_pass, shot, duel = name == "Pass", name == "Shot", name == "Duel"
    defending, attacking, carry = sub == "Ground defending duel", sub == "Ground attacking duel", sub == "Acceleration"
    decided = tag["won"] | tag["lost"]
    return events.withColumns(
        {
            "origin_x": ox,
            "origin_y": oy,
            "is_pass": a_pass,
            "pass_accurate": a_pass & tag["accurate"],
            "pass_not_accurate": a_pass & tag["not_accurate"],
            "is_cross": sub == "Cross",
            "is_long_ball": sub == "Launch",
            "is_smart_pass": sub == "Smart pass",
            "is_progressive_pass": a_pass & (forward >= PROGRESSIVE),
            "pass_progress": F.when(a_pass, floored(forward)).otherwise(0.0),
            "is_assist": tag["assist"],
            "is_key_pass": tag["key_pass"],
            "is_through_ball": a_pass & tag["through"],
            "is_box_entry": a_pass & (dx >= BOX_X) & dy.between(*BOX_Y),
            "is_shot": shot,
            "shot_goal": shot & tag["goal"],
            "scorer_goal": tag["goal"] & (shot | sub.isin(SCORING_SET_PIECES)),
            "shot_on_target": shot & (tag["goal_zone"] | tag["goal"]),
            "shot_blocked": shot & tag["blocked"],
            "is_interception": tag["interception"],
            "is_sliding_tackle": tag["sliding_tackle"],
            "is_clearance": sub == "Clearance",
            "def_duel_won": defending & tag["won"],
            "def_duel_decided": defending & decided,
            "is_touch": sub == "Touch",
            "is_duel": duel,
            "duel_won": duel & tag["won"],
            "duel_decided": duel & decided,
            "is_carry": carry,
            "carry_distance": F.when(carry, forward).otherwise(0).cast("double"),
            "take_on_attempt": attacking & tag["take_on"],
            "take_on_success": attacking & tag["take_on"] & tag["won"],
            "in_defensive_third": ox < 33.3,
            "in_middle_third": (ox >= 33.3) & (ox < 66.7),
            "in_attacking_third": ox >= 66.7,
        }
    )


def with_flags_2(events: DataFrame) -> DataFrame:
    """Flags and measures of the second provider's flat events, on a pitch of 120 x 80."""
    c = F.col
    x, y = rescale(c("location_x"), 120.0), rescale(c("location_y"), 80.0)
    ex, ey = rescale(c("end_location_x"), 120.0), rescale(c("end_location_y"), 80.0)
    kind, outcome, duel_outcome = c("type_name"), c("shot_outcome_name"), c("duel_outcome_name")
    a_pass, shot, duel, carry, dribble = kind == "Pass", (kind == "Shot") & (c("shot_type_name") == "Open Play"), kind == "Duel", kind == "Carry", kind == "Dribble"
    tackle = duel & (c("duel_type_name") == "Tackle")
    won, lost = duel_outcome.isin(*TACKLE_WON), duel_outcome.isin(*TACKLE_LOST)
    forward = ex - x
    return events.withColumns(
        {
            "origin_x": x,
            "origin_y": y,
            "is_pass": a_pass,
            "pass_accurate": a_pass & c("pass_outcome_name").isNull(),
            "pass_not_accurate": a_pass & c("pass_outcome_name").isin(*PASS_FAILED),
            "is_cross": a_pass & c("pass_cross"),
            "is_long_ball": a_pass & (c("pass_height_name") == "High Pass") & (c("pass_length") >= 30),
            "is_progressive_pass": a_pass & (forward >= PROGRESSIVE),
            "pass_progress": F.when(a_pass, floored(forward)).otherwise(0.0),
            "is_assist": a_pass & c("pass_goal_assist"),
            "is_key_pass": a_pass & c("pass_shot_assist"),
            "is_through_ball": a_pass & c("pass_through_ball"),
            "is_box_entry": a_pass & (ex >= BOX_X) & ey.between(*BOX_Y),
            "is_shot": shot,
            "shot_goal": shot & (outcome == "Goal"),
            "scorer_goal": shot & (outcome == "Goal"),
            "shot_on_target": shot & outcome.isin(*SHOT_ON_TARGET),
            "shot_blocked": shot & (outcome == "Blocked"),
            "is_interception": kind == "Interception",
            "is_sliding_tackle": tackle,
            "is_clearance": kind == "Clearance",
            "def_duel_won": tackle & won,
            "def_duel_decided": tackle & (won | lost),
            "is_touch": kind == "Ball Receipt*",
            "is_duel": duel,
            "duel_won": duel & duel_outcome.isin(*DUEL_WON),
            "duel_decided": duel & (duel_outcome.isin(*DUEL_WON, *DUEL_LOST) | (c("duel_type_name") == "Aerial Lost")),
            "is_carry": carry,
            "carry_distance": F.when(carry, floored(forward)).otherwise(0.0),
            "take_on_attempt": dribble,
            "take_on_success": dribble & (c("dribble_outcome_name") == "Complete"),
            "in_defensive_third": x < 100 / 3,
            "in_middle_third": (x >= 100 / 3) & (x < 200 / 3),
            "in_attacking_third": x >= 200 / 3,
        }
    )


def statistics(flagged: DataFrame, keys: list[str], means_as_sums: bool = False, also: dict[str, Column] | None = None) -> DataFrame:
    """Additive statistics of each key: counts, sums of flags and measures, and means;
    ``means_as_sums`` keeps a sum and a count for each mean, so groups can be joined later.
    ``also`` are further aggregates."""
    have = set(flagged.columns)
    out = [F.count("*").alias("n_events"), *(x.alias(n) for n, x in (also or {}).items())]
    out += [(total(F.col(c)) if c in MEASURES else flag_sum(F.col(c))).alias(c) for c in SUMS if c in have]
    for c in MEANS:
        value = F.col(c).cast("double")
        if means_as_sums:
            out += [total(value).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n")]
        else:
            out.append(share(F.col(c)).alias(c))
    return flagged.groupBy(*keys).agg(*out)


def derive(stats: DataFrame, keys: list[str], minutes: str = "minutes_played", features: dict = FEATURES, with_counts: bool = False) -> DataFrame:
    """The features of each row of ``stats``, which has the keys, minutes and statistics."""

    def known(name: str) -> Column:
        parts = [F.coalesce(F.col(p), F.lit(0)) for p in name.split("+")]
        return sum(parts[1:], parts[0])

    columns = []
    for feature, (kind, parts) in features.items():
        if kind == "rate":
            # events of a profile without any are unknown in the count of all rows
            count = F.col(parts[0]) if parts[0] == "n_events" else known(parts[0])
            columns.append(per_90(count, F.col(minutes)).alias(feature))
        elif kind == "ratio":
            columns.append(safe_ratio(known(parts[0]), known(parts[1])).alias(feature))
        else:
            columns.append(F.col(parts[0]).alias(feature))
    counts = [known(p).alias(f"{f}__{n}") for f, ps in RATIOS.items() if f in features for n, p in zip(("successes", "attempts"), ps)] if with_counts else []
    return stats.select(*keys, minutes, *columns, *counts)


def player_features(flagged: DataFrame, minutes: DataFrame, keys: list[str], features: dict = FEATURES, with_counts: bool = False) -> DataFrame:
    """A row per row of ``minutes`` (keys, minutes_played), by one grouped aggregation."""
    joined = minutes.select(*keys, "minutes_played").join(statistics(flagged, keys), keys, "left")
    joined = joined.withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return derive(joined, keys, features=features, with_counts=with_counts)


def player_match_statistics(flagged: DataFrame, player_match_minutes: DataFrame) -> DataFrame:
    """Sufficient statistics for each player and match with minutes."""
    keys = ["player_id", "match_id"]
    return player_match_minutes.join(statistics(flagged, keys, means_as_sums=True), keys, "left")


def weighted_features(stats: DataFrame, weights: DataFrame, keys: list[str], features: dict = FEATURES, with_counts: bool = False) -> DataFrame:
    """Features of ``stats`` (a row per player and match) with each match counted
    ``multiplicity`` times.  Weights that are null, not positive or repeated for a
    match are an error, raised while the query runs."""
    once = weights.groupBy(*[c for c in weights.columns if c != "multiplicity"]).agg(
        F.count("*").alias("_n"), F.min("multiplicity").alias("multiplicity"), F.count("multiplicity").alias("_known")
    )
    bad = (F.col("_n") != 1) | (F.col("_known") != 1) | (F.col("multiplicity") <= 0)
    checked = F.when(bad, F.raise_error(F.lit("match weights must be positive and unique")).cast("long")).otherwise(F.col("multiplicity"))
    once = once.withColumn("multiplicity", checked).drop("_n", "_known")
    joined = stats.join(once, [c for c in once.columns if c != "multiplicity"])
    times = lambda c: total(F.col(c) * F.col("multiplicity")).alias(c)
    sums = [c for c in ("minutes_played", "n_events", *SUMS) if c in stats.columns]
    grouped = joined.groupBy(*keys).agg(*(times(c) for c in sums), *(times(f"{c}__{p}") for c in MEANS for p in ("sum", "n")))
    means = {c: safe_ratio(F.col(f"{c}__sum"), F.col(f"{c}__n")) for c in MEANS}
    return derive(grouped.withColumns(means), keys, features=features, with_counts=with_counts)
