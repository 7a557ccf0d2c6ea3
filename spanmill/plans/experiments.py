"""Experiments over eligible profiles: ranks of every baseline, robustness, reports.

``profiles`` has the entity columns, period (A queries, B candidates), minutes_played
and the features; further columns serve as scopes and attributes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.operators import resampling, retrieval
from spanmill.sources.scratch import written


@dataclass(frozen=True)
class Population:
    """Queries and candidates on one scale."""

    queries: DataFrame
    candidates: DataFrame
    entity: list[str]
    carry: list[str]


def population(profiles: DataFrame, features: Sequence[str], entity: list[str], carry: Sequence[str] = (), scale_on: DataFrame | None = None, minutes: str = "minutes_played", digits: int = 6, weights: Sequence[float] | None = None) -> Population:
    """Standardised on both periods, or on ``scale_on``; z-scores are rounded so that results
    don't depend on the order of sums.

    The features are written once as vectors, since the scales and the scores read them, and the scaled vectors once, so
    that no later job scales anew."""
    from spanmill.functions.numeric import weighted

    raw = written(retrieval.as_vectors(profiles, features, [*entity, "period", *carry, minutes]).withColumnRenamed(minutes, "minutes"))
    scales = retrieval.fit_scales(raw if scale_on is None else retrieval.as_vectors(scale_on, features, []))
    vectors = retrieval.scaled_vectors(raw, scales, digits)
    if weights is not None:
        vectors = vectors.withColumn("v", weighted(F.col("v"), weights))
    vectors = written(vectors)
    split = lambda p: vectors.where(F.col("period") == p).drop("period")
    return Population(split("A"), split("B"), list(entity), list(carry))


def baseline_ranks(p: Population, baseline: str, scope: str | None = None, role: str = "role", team: str = "team", digits: int = 6) -> DataFrame:
    """A: role, then minutes.  B: cosine.  B-euclidean.  C: role, team, then minutes."""
    if baseline in ("B", "B-euclidean"):
        return retrieval.vector_ranks(p.queries, p.candidates, p.entity, "cosine" if baseline == "B" else "euclidean", scope, digits)
    exact = {"A": [role], "C": [role, team]}[baseline]
    return retrieval.profile_ranks(p.queries, p.candidates, p.entity, exact, scope)


def report(p: Population, baselines: Sequence[str] = ("A", "B", "C"), scopes: Sequence[str | None] = (None, "role")) -> DataFrame:
    """(scope, baseline, n_queries, mrr, median_rank, recalls, chance)."""
    out = None
    for scope in scopes:
        for b in baselines:
            ranks = written(baseline_ranks(p, b, scope))  # a row per query, read twice
            row = retrieval.metrics(ranks).crossJoin(F.broadcast(ranks.agg(resampling.chance_level(ranks).alias("chance"))))  # one row each
            row = row.select(F.lit(scope or "global").alias("scope"), F.lit(b).alias("baseline"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def mrr_delta(first: DataFrame, second: DataFrame, entity: list[str]) -> DataFrame:
    """A row per query of both tables: 1/rank of the second minus that of the first."""
    a = first.select(*entity, F.col("rank").alias("_a"))
    b = second.select(*entity, F.col("rank").alias("_b"))
    return a.join(b, entity).select(*entity, (F.lit(1.0) / F.col("_b") - F.lit(1.0) / F.col("_a")).alias("delta"))


def delta_summary(first: DataFrame, second: DataFrame, entity: list[str], replicates: int = 1000, seed: int = 0, clusters: DataFrame | None = None) -> DataFrame:
    """One row: the mean difference of reciprocal ranks, its bounds and the counts behind them.

    With ``clusters`` (entity, cluster) whole clusters of queries are drawn and
    pooled, so resamples differ in size; a query without cluster stops the
    query.  Without queries the means are null and the counts 0."""
    deltas = written(mrr_delta(first, second, entity))  # a row per query, read by several jobs
    point = [F.avg("delta").alias("point_estimate"), F.count("*").alias("n_queries")]
    if clusters is None:
        drawn = resampling.resample_means(deltas, "delta", entity, replicates, seed)
    else:
        deltas = deltas.join(clusters.select(*entity, "cluster"), entity, "left")
        point.append(F.count_distinct("cluster").alias("n_clusters"))
        drawn = resampling.cluster_resample(deltas, "delta", "cluster", replicates, seed)
    return deltas.agg(*point).crossJoin(F.broadcast(resampling.interval(drawn, "mean")))  # one row each


def without_teammates(p: Population, team: str = "team", digits: int = 6) -> DataFrame:
    """Ranks by cosine when other candidates of the query's team are left out."""
    return retrieval.vector_ranks(p.queries, p.candidates, p.entity, digits=digits, apart=team)


def ablation(profiles: DataFrame, families: dict[str, Sequence[str]], entity: list[str], carry: Sequence[str] = (), leave_out: bool = False) -> DataFrame:
    """Metrics with the features of one family only (or of all others)."""
    everything = [f for fs in families.values() for f in fs]
    out = None
    for name, fs in families.items():
        used = [f for f in everything if f not in fs] if leave_out else list(fs)
        row = retrieval.metrics(baseline_ranks(population(profiles, used, entity, carry), "B")).withColumn("family", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def transfer_report(p: Population, moved: DataFrame, baselines: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Metrics of transferred queries only; pools stay whole."""
    only = Population(p.queries.join(moved.select(*p.entity), p.entity, "left_semi"), p.candidates, p.entity, p.carry)
    return report(only, baselines, [None])
