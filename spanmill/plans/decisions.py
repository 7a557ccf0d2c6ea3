"""Selection, gates and preregistration around a learned metric: small rules on summary numbers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.operators import retrieval
from spanmill.plans import experiments

# Fixed values of the decision rule.
KEEP_DELTA, WORST_ROLE, EXTERNAL_LOW, MIN_QUERIES = 0.020, -0.020, -0.010, 50
CONTINUE_DELTA, CONTINUE_LOW = 0.010, -0.005
BUDGETS = {"seconds": 1800, "peak_bytes": 4 << 30, "artifact_bytes": 5 << 20}


@dataclass(frozen=True)
class Clause:
    name: str
    observed: float
    passed: bool


def select_arm(results: DataFrame) -> DataFrame:
    """One row of ``results`` (regularization, mrr): the best mrr, ties to the stronger pull."""
    return results.orderBy(F.desc("mrr"), F.desc("regularization")).limit(1)


def continuation(delta: float, low: float) -> bool:
    return delta >= CONTINUE_DELTA and low > CONTINUE_LOW


def by_role(reference: DataFrame, learned: DataFrame, entity: Sequence[str], role: DataFrame, minimum: int = MIN_QUERIES) -> DataFrame:
    """(role, n_queries, reference_mrr, learned_mrr, delta, gates): roles with too few queries are
    reported and don't gate."""
    a = reference.select(*entity, (F.lit(1.0) / F.col("rank")).alias("_a"))
    b = learned.select(*entity, (F.lit(1.0) / F.col("rank")).alias("_b"))
    joined = a.join(b, list(entity)).join(role, list(entity))
    out = joined.groupBy("role").agg(F.count("*").alias("n_queries"), F.avg("_a").alias("reference_mrr"), F.avg("_b").alias("learned_mrr"))
    return out.withColumns({"delta": F.col("learned_mrr") - F.col("reference_mrr"), "gates": F.col("n_queries") >= minimum})


def clauses(delta: float, low: float, roles: Mapping[str, tuple[int, float]], external_delta: float, external_low: float, within_budget: bool) -> list[Clause]:
    """``roles``: name -> (queries, delta)."""
    worst = min((d for n, d in roles.values() if n >= MIN_QUERIES), default=0.0)
    return [
        Clause("delta on the test split", delta, delta >= KEEP_DELTA),
        Clause("lower bound of the delta", low, low > 0),
        Clause("worst gating role", worst, worst >= WORST_ROLE),
        Clause("delta on the other provider", external_delta, external_delta > 0),
        Clause("lower bound on the other provider", external_low, external_low > EXTERNAL_LOW),
        Clause("budgets", float(within_budget), within_budget),
    ]


def keep(rows: Sequence[Clause]) -> str:
    return "KEEP" if all(c.passed for c in rows) else "DROP"


def budgets(runs: Sequence[Mapping[str, float]]) -> dict[str, bool]:
    """The largest of all runs counts."""
    return {k: max((r[k] for r in runs), default=0) <= most for k, most in BUDGETS.items()}


def protocol_hash(protocol: Mapping) -> str:
    return hashlib.sha256(json.dumps(protocol, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def assert_registered(protocol: Mapping, log: Path) -> None:
    """Held-out rows may be read only when the log names the protocol's hash."""
    if protocol_hash(protocol) not in log.read_text():
        raise PermissionError("the protocol isn't registered; the test split stays locked")


def grid(profiles: DataFrame, features: Sequence[str], entity: list[str], arms: Mapping[float, Sequence[float]], scope: str = "role") -> DataFrame:
    """(regularization, mrr): metrics of each arm's weights."""
    out = None
    for strength, weights in arms.items():
        p = experiments.population(profiles, features, entity, [scope], weights=weights)
        row = retrieval.metrics(experiments.baseline_ranks(p, "B", scope)).select(F.lit(float(strength)).alias("regularization"), "mrr")
        out = row if out is None else out.unionByName(row)
    return out


def failure_cases(ranks: DataFrame, entity: Sequence[str], n: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), *entity).limit(n)


def sample_queries(queries: DataFrame, entity: list[str], per_role: int, seed: int, role: str = "role", league: str = "league", team: str = "team") -> DataFrame:
    """Queries for a study: of each team one (the first in a seeded order), then leagues in turn
    within each role until ``per_role`` are taken."""
    key = F.xxhash64(F.lit(seed), *(F.col(e) for e in entity))
    one_a_team = queries.withColumn("_k", key).withColumn("_t", F.row_number().over(Window.partitionBy(team).orderBy("_k", *entity))).where("_t = 1")
    turn = one_a_team.withColumn("_turn", F.row_number().over(Window.partitionBy(role, league).orderBy("_k", *entity)))
    place = F.row_number().over(Window.partitionBy(role).orderBy("_turn", F.xxhash64(F.lit(seed), league), "_k"))
    return turn.withColumn("_place", place).where(F.col("_place") <= per_role).select(*queries.columns)
