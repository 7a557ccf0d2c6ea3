"""The published bundle: catalog, profile index, documents, manifest, and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.text import has_escape, profile_key
from spanmill.operators import features as feats
from spanmill.operators import quality

_PLACE = ("mean_x", "mean_y")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """(feature_id, family, catalog_order, unit, precision, null_meaning, support)."""
    family = {f: name for name, fs in feats.FAMILIES.items() for f in fs}
    rows = []
    for i, (f, (kind, _)) in enumerate(feats.FEATURES.items()):
        share = kind == "mean" and f not in _PLACE
        unit, precision = ("ratio", 3) if kind == "ratio" or share else ("pitch_percent", 1) if f in _PLACE else ("distance_per_90", 1) if "distance" in f else ("per_90", 2)
        null = "no_attempts" if kind == "ratio" else "not_observed" if kind == "mean" else None
        rows.append((f, family[f], i, unit, precision, null, "attempts" if kind == "ratio" else "minutes"))
    return spark.createDataFrame(rows, "feature_id string, family string, catalog_order int, unit string, precision int, null_meaning string, support string")


def player_index(profiles: DataFrame, players: DataFrame, competitions: DataFrame) -> DataFrame:
    """(profile_key, player_id, competitionId, name, role, competition), a row per profile pair."""
    pairs = profiles.select("player_id", "competitionId").distinct()
    named = pairs.join(players, "player_id", "left").join(competitions, "competitionId", "left")
    return named.select(profile_key(F.col("player_id"), F.col("competitionId")).alias("profile_key"), "player_id", "competitionId", "name", "role", "competition")


def period_dates(matches: DataFrame, periods: DataFrame) -> DataFrame:
    """(competitionId, period, first_date, last_date, n_matches)."""
    joined = matches.select("match_id", F.substring(F.col("date").cast("string"), 1, 10).alias("day")).join(periods, "match_id")
    return joined.groupBy("competitionId", "period").agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count("*").alias("n_matches"))


def team_contexts(minutes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Teams of each profile by minutes, most first (ties: smaller team)."""
    summed = minutes.groupBy(*keys, "team_id").agg(F.sum("minutes_played").alias("minutes"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("minutes")).alias("o"), "team_id", "minutes")))
    return summed.groupBy(*keys).agg(F.transform(ordered, lambda t: F.struct(t["team_id"].alias("team_id"), t["minutes"].alias("minutes"))).alias("teams"))


def drift(computed: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], within: float = 1e-12) -> DataFrame:
    """Keys on which two tables differ: missing on a side, a null against a value, or beyond ``within``."""
    a = computed.select(*keys, F.struct(*columns).alias("_a"))
    b = stored.select(*keys, F.struct(*columns).alias("_b"))
    differs = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        differs = differs | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > within, F.lit(False))
    return a.join(b, list(keys), "full").where(differs).select(*keys)


def validate_neighbors(neighbors: DataFrame, index: DataFrame, key: str = "profile_key", k: int = 5) -> DataFrame:
    """Checks of published neighbours (key, rank, neighbor, score, player, neighbor_player, role,
    neighbor_role), as rows of a quality suite."""
    lists = neighbors.groupBy(key).agg(
        F.array_sort(F.collect_list("rank")).alias("ranks"), F.count_distinct("neighbor").alias("n"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "neighbor", "rank"))).alias("by_score"),
    )
    wanted = F.array(*(F.lit(i) for i in range(1, k + 1)))
    order = F.transform("by_score", lambda x: x["rank"])
    per_key = quality.run_checks(
        lists,
        [
            quality.Check("ranks 1..k", F.count_if(F.col("ranks").cast("array<int>") != wanted), F.count("*")),
            quality.Check("distinct neighbors", F.count_if(F.col("n") != k), F.count("*")),
            quality.Check("ordered by score", F.count_if(order.cast("array<int>") != wanted), F.count("*")),
        ],
    )
    per_row = quality.run_checks(
        neighbors,
        [
            quality.Check("another player", F.count_if(F.col("player") == F.col("neighbor_player")), F.count("*")),
            quality.Check("same role", F.count_if(~F.col("role").eqNullSafe(F.col("neighbor_role"))), F.count("*")),
        ],
    )
    known = quality.orphans(neighbors, "neighbor", index, key, "neighbor")
    return quality.suite([per_key, per_row, known])


def validate_values(values: DataFrame) -> DataFrame:
    """Checks of published feature values (raw_value, z, percentile, imputed)."""
    return quality.run_checks(
        values,
        [
            quality.in_range("percentile", 0, 100),
            quality.Check("null is imputed with z 0", F.count_if(F.col("raw_value").isNull() & (~F.col("imputed") | (F.col("z") != 0))), F.count("*")),
            quality.Check("observed isn't imputed", F.count_if(F.col("raw_value").isNotNull() & F.col("imputed")), F.count("*")),
        ],
    )


def validate_identities(index: DataFrame, *texts: str) -> DataFrame:
    return quality.run_checks(index, [quality.Check(f"no escapes in {t}", F.count_if(has_escape(F.col(t))), F.count(t)) for t in texts])


def fingerprint_rows(values: DataFrame, catalog: DataFrame, key: str = "profile_key") -> DataFrame:
    """Both periods of each feature side by side in catalog order, with the shift of the percentile."""
    side = lambda p: values.where(F.col("period") == p).select(key, "feature_id", F.col("value").alias(f"value_{p.lower()}"), F.col("percentile").alias(f"percentile_{p.lower()}"))
    joined = side("A").join(side("B"), [key, "feature_id"], "full").join(F.broadcast(catalog), "feature_id")  # the catalog has 32 rows
    return joined.withColumn("shift", F.col("percentile_b") - F.col("percentile_a"))
