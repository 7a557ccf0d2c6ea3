"""Scaling, ranks, neighbours, metrics, diagnostics, evidence."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import diagnostics, evidence, retrieval


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scaler_nulls_and_constants(spark):
    df = frame(spark, [(1, 1.0, 5.0, None), (2, None, 5.0, None), (3, 3.0, 5.0, None)], "id long, a double, b double, c double")
    got = retrieval.standardize(df, ["a", "b", "c"]).orderBy("id").collect()
    spread = np.std([1, 2, 3], ddof=1)
    assert [r.a for r in got] == pytest.approx([-1 / spread, 0.0, 1 / spread]) and {r.b for r in got} == {r.c for r in got} == {0.0}


def test_scales_of_vectors(spark):
    """The same z-scores as by columns, by an aggregation whose length doesn't grow with the features."""
    rows = [(i, float(i * i % 7), None if i % 3 else i / 7, 5.0, None, float("nan") if i == 4 else i * 1e9) for i in range(20)]
    df = frame(spark, rows, "id long, a double, b double, c double, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    wide = {r.id: [r[f] for f in names] for r in retrieval.standardize(df, names).withColumns({f: F.round(f, 6) for f in names}).collect()}
    v = retrieval.as_vectors(df, names, ["id"])
    got = {r.id: r.v for r in retrieval.scaled_vectors(v, retrieval.fit_scales(v), 6).collect()}
    assert got.keys() == wide.keys() and all(got[k] == pytest.approx(wide[k], nan_ok=True) for k in wide)
    assert {x for r in retrieval.scaled_vectors(v, retrieval.fit_scales(v.where("id < 0")), 6).collect() for x in r.v} == {0.0}


def ranks(q, c, entity, keys, **k):
    return {tuple(r[e] for e in entity): (r["rank"], r.pool_size) for r in retrieval.self_ranks(q, c, entity, keys, **k).collect()}


def test_role_before_minutes_and_ties(spark):
    schema = "player_id long, role string, minutes double"
    q = frame(spark, [(2, "F", 1000.0)], schema)
    c = frame(spark, [(1, "F", 500.0), (2, "D", 1000.0)], schema)
    assert ranks(q, c, ["player_id"], retrieval.profile_keys("role")) == {(2,): (2, 2)}
    q = frame(spark, [(5, "F", 1000.0)], schema)
    c = frame(spark, [(5, "F", 900.0), (2, "F", 1100.0)], schema)
    assert ranks(q, c, ["player_id"], retrieval.profile_keys("role")) == {(5,): (2, 2)}


def test_same_id_in_two_competitions(spark):
    schema = "player_id long, competitionId long, v array<double>"
    q = frame(spark, [(1, 200, [1.0, 0.0]), (9, 9, [1.0, 1.0])], schema)
    c = frame(spark, [(1, 100, [0.0, 1.0]), (1, 200, [1.0, 0.1]), (2, 200, [0.5, 1.0])], schema)
    got = {(r.player_id, r.competitionId): (r["rank"], r.pool_size) for r in retrieval.vector_ranks(q, c, ["player_id", "competitionId"]).collect()}
    assert got == {(1, 200): (1, 3)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_ranks_like_numpy(spark, metric):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(40, 5))
    b[7] = 0.0
    q, c = (frame(spark, [(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>") for m in (a, b))
    got = {r.id: r["rank"] for r in retrieval.vector_ranks(q, c, ["id"], metric).collect()}
    if metric == "cosine":
        s = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.where(np.linalg.norm(b, axis=1) > 0, np.linalg.norm(b, axis=1), 1))
    else:
        s = -np.linalg.norm(a[:, None] - b[None], axis=2)
    want = {i: 1 + sum((s[i, j], -j) > (s[i, i], -i) for j in range(40) if j != i) for i in range(40)}
    assert got == want
    top = retrieval.top_neighbors(q, c, ["id"], 3, metric).where("id = 4").orderBy("rank").collect()
    assert [r.neighbor_id for r in top] == sorted(range(40), key=lambda j: (-s[4, j], j))[:3]
    with pytest.raises(ValueError, match="unknown metric"):
        retrieval.vector_ranks(q, c, ["id"], "manhattan")


def test_metrics(spark):
    r = retrieval.metrics(frame(spark, [(1,), (2,), (4,), (11,)], "rank int")).first()
    assert (r.n_queries, r.median_rank, r.recall_at_1, r.recall_at_5, r.recall_at_10) == (4, 3.0, 0.25, 0.75, 0.75) and r.mrr == pytest.approx((1 + 0.5 + 0.25 + 1 / 11) / 4)
    with pytest.raises(Exception, match="no ranks"):
        retrieval.metrics(frame(spark, [], "rank int")).collect()


def test_primary_team_and_transfers(spark):
    rows = [(1, "A", 5, 90), (1, "A", 6, 90), (1, "B", 6, 10), (2, "A", 5, 1), (3, "A", 5, 1), (3, "B", 5, 1)]
    primary = diagnostics.primary_value(frame(spark, rows, "player_id long, period string, team_id long, m long"), ["player_id", "period"], "team_id", "m")
    assert {(r.player_id, r.period): r.team_id for r in primary.collect()} == {(1, "A"): 5, (1, "B"): 6, (2, "A"): 5, (3, "A"): 5, (3, "B"): 5}
    assert [tuple(r) for r in diagnostics.transferred(primary, primary, ["player_id"]).collect()] == [(1, 5, 6)]


def test_concentration(spark):
    near = frame(spark, [(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, False)], "id long, neighbor_id long, is_true_match boolean")
    team = frame(spark, [(1, "x"), (2, "x"), (3, "y")], "id long, team string")
    assert diagnostics.concentration(near, team, team, ["id"], "team").first()[0] == pytest.approx(1 / 3)
    assert diagnostics.concentration(near.limit(0), team, team, ["id"], "team").first()[0] == 0.0
    with pytest.raises(Exception, match="repeated keys"):
        diagnostics.concentration(near, team.union(team), team, ["id"], "team").collect()


def test_contributions_add_up(spark):
    pairs = frame(spark, [(1, [1.0, 2.0, 0.0], [2.0, 1.0, 5.0]), (2, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "id long, qv array<double>, cv array<double>")
    w = [1.0, 0.5, 2.0]
    rows = evidence.contributions(pairs, ["a", "b", "c"], {"f": ["a", "b"], "g": ["c"]}, w)
    q, c, w = np.array([1, 2, 0.0]), np.array([2, 1, 5.0]), np.array(w)
    score = float((q * c * w).sum() / np.sqrt((q * q * w).sum() * (c * c * w).sum()))
    got = rows.where("id = 1").orderBy("place").collect()
    assert sum(r.contribution for r in got) == pytest.approx(score, abs=1e-8) and [r.feature_id for r in got] == ["a", "b", "c"]
    scores = frame(spark, [(1, score), (2, 0.0)], "id long, score double")
    assert evidence.check_totals(rows, scores, ["id"]).count() == 0
    assert evidence.check_totals(rows, scores.withColumn("score", F.col("score") + 1), ["id"]).count() == 2
    assert {r.family_id for r in evidence.family_contributions(rows, ["id"]).collect()} == {"f", "g"}


def test_replication_leaves_carries_out_of_the_28(spark):
    """Against a plain version: the 28 features are those without the two of carries, the 30 hold them."""
    from spanmill import queries_more as more

    sf_dir, carries = "/root/testdata/sf0.001", {"carry_proxy_p90", "carry_distance_proxy_p90"}
    assert len(more.SHARED_28) == 28 and set(more.SHARED_30) - set(more.SHARED_28) == carries
    rows = more.QUERIES["provider_period_profiles_2"](spark, sf_dir).orderBy("period", "player_id").collect()
    want = {}
    for name, out in (("28", carries), ("30", set())):
        x = np.array([[r[f] for f in more.SHARED_30 if f not in out] for r in rows], float)
        x = np.where(np.isnan(x), np.nanmean(x, 0), x)
        spread = x.std(0, ddof=1)
        z = np.round((x - x.mean(0)) / np.where(spread > 0, spread, 1.0), 6)
        a, b = z[: len(z) // 2], z[len(z) // 2 :]
        score = np.round(a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1), 6)
        want[name] = np.mean([1 / (1 + sum((-s, j) < (-row[i], i) for j, s in enumerate(row))) for i, row in enumerate(score)])
    got = more.QUERIES["provider_replication"](spark, sf_dir).where("scope = 'global' AND baseline = 'B'").collect()
    assert {r.features: r.mrr for r in got} == pytest.approx(want) and want["28"] != want["30"]
