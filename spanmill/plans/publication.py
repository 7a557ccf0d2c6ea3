"""What a published profile carries beside its values: support, uncertainty, caveats, and the representation its scores come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators import quality

STATUSES = ("available", "insufficient")

# Caveat code -> (severity, message).
CAVEATS = {
    "fingerprint_not_style_proof": ("critical", "A stable event-derived fingerprint is evidence of individual signal, not proof of playing style."),
    "similarity_not_recruitment": ("critical", "Statistical proximity is descriptive and must not be read as a recruitment recommendation."),
    "same_season_team_confound": ("critical", "Same-season club continuity is a strong confound and can make identity retrieval easier."),
    "small_transfer_sample": ("important", "Transferred-player evidence is based on a small sample and has wide uncertainty."),
    "provider_replication_lower_magnitude": ("important", "The independent-provider replication is positive but lower in magnitude than the Wyscout result."),
    "within_role_display_differs_from_global_model": ("context", "Within-role percentiles aid display; cosine retrieval uses globally standardized values."),
    "uncertainty_pending": ("important", "Match-level sampling-stability intervals are not available in this dataset version."),
    "uncertainty_sampling_only": ("important", "Sampling intervals describe stability in observed matches, not causal or future-performance uncertainty."),
    "goalkeeper_feature_coverage_weak": ("critical", "The native 32-feature catalog is outfield-oriented and has weak goalkeeper-specific coverage."),
}
_ALWAYS = ("fingerprint_not_style_proof", "similarity_not_recruitment", "same_season_team_confound", "within_role_display_differs_from_global_model")


def support(feature: Column, minutes: Column, ratios: Mapping[str, tuple[str, Sequence[str]]]) -> Column:
    """Struct (minutes, attempts, successes) behind a value; ``ratios`` names the success column and
    the attempt columns of each ratio, other features have minutes only."""
    attempts, successes = F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, (success, parts) in ratios.items():
        total = sum((F.col(p).cast("long") for p in parts[1:]), F.col(parts[0]).cast("long"))
        attempts, successes = F.when(feature == name, total).otherwise(attempts), F.when(feature == name, F.col(success).cast("long")).otherwise(successes)
    return F.struct(minutes.cast("long").alias("minutes"), attempts.alias("attempts"), successes.alias("successes"))


def attach_uncertainty(rows: DataFrame, summaries: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]], rates: Sequence[str] = (), to: str = "uncertainty", representation: str | None = None) -> DataFrame:
    """``rows`` with a struct of what ``summaries`` (keys, status, n_valid, bounds, rates) says of them.

    ``pairs`` names the two bounds of each interval, published as a pair; an
    insufficient summary publishes only its status and count.  A row without
    summary, a key with two, or another status stops the query.  With
    ``representation`` the block names the metric it was computed under."""
    shown = F.col("status") == "available"
    both = {n: F.col(low).isNotNull() & F.col(high).isNotNull() for n, (low, high) in pairs.items()}
    fields = [F.col("status"), F.col("n_valid").cast("long").alias("valid_resamples")]
    fields += [F.when(shown & both[n], F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias(n) for n, (low, high) in pairs.items()]
    fields += [F.when(shown, F.col(r).cast("double")).alias(r) for r in rates]
    if representation is not None:
        fields.append(F.lit(representation).alias("representation_id"))
    blocks = summaries.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_block"))
    stop = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.concat_ws("|", *(F.col(k).cast("string") for k in keys))))
    fault = (
        F.when(F.col("_n").isNull(), stop("no uncertainty for a row"))
        .when(F.col("_n") > 1, stop("two summaries of a key"))
        .when(~F.coalesce(F.col("_block.status").isin(*STATUSES), F.lit(False)), stop("unexpected status"))
    )
    joined = rows.join(blocks, list(keys), "left")
    return joined.withColumn(to, F.when(fault.cast("string").isNull(), F.col("_block"))).select(*rows.columns, to)


def caveat(code: str) -> Column:
    severity, message = CAVEATS[code]
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def profile_caveats(role: Column, status: Column) -> Column:
    """Array of caveats of a profile: the standing ones, one on uncertainty, one on goalkeepers."""
    standing = F.array(*(caveat(c) for c in _ALWAYS))
    sampling = F.when(F.coalesce(status, F.lit("pending")) == "pending", F.array(caveat("uncertainty_pending"))).otherwise(F.array(caveat("uncertainty_sampling_only")))
    keeper = F.when(role == "Goalkeeper", F.array(caveat("goalkeeper_feature_coverage_weak"))).otherwise(F.slice(standing, 1, 0))
    return F.concat(standing, sampling, keeper)


def weight_vector(weights: Mapping[str, float], excluded: Sequence[str], features: Sequence[str]) -> list[float]:
    """Weights in the order of ``features``; an excluded feature has weight 0.  A feature in both
    lists or in neither is an error."""
    twice = sorted(set(excluded) & set(weights))
    if twice:
        raise ValueError(f"weighted and excluded: {twice}")
    unknown = [f for f in features if f not in weights and f not in set(excluded)]
    if unknown:
        raise ValueError(f"neither weighted nor excluded: {unknown}")
    return [float(weights.get(f, 0.0)) for f in features]


def representation(weights: Mapping[str, float], order: Sequence[str]) -> dict[str, str]:
    """Digests of a weight vector and of its order: SHA-256 of compact JSON, weights to 12 places."""
    digest = lambda value: hashlib.sha256(json.dumps(value, separators=(",", ":")).encode()).hexdigest()
    return {"weight_digest": digest([[f, round(float(weights[f]), 12)] for f in order]), "feature_order_digest": digest(list(order))}


def binding_faults(documents: DataFrame, expected: str, key: str = "path", document: str = "document") -> DataFrame:
    """(key, representation_id) of every reference in JSON documents to another representation,
    and (key, null) for a document that names none."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(document), F.lit(r'"representation_id"\s*:\s*"([^"]*)"'), F.lit(1)))
    other = F.when(F.coalesce(F.size(ids), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.filter(ids, lambda i: i != expected))
    return documents.select(key, F.explode(other).alias("representation_id"))


def reconstruction(rows: DataFrame, scores: DataFrame, keys: Sequence[str], value: str = "weighted_contribution", within: float = 1e-6) -> DataFrame:
    """One result row of a quality suite: scores that their contributions don't add up to within
    ``within``; a null score isn't checked."""
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = scores.join(totals, list(keys), "left")
    off = F.coalesce(F.abs(F.col("_total") - F.col("score")) > within, F.col("_total").isNull())
    return quality.run_checks(joined.where(F.col("score").isNotNull()), [quality.Check("contributions add up to the score", F.count_if(off), F.count("*"))])
