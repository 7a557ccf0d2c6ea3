"""Draws, resampling, percentiles, shrinkage, splits, study statistics, metric learning."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill import queries
from spanmill.functions import hashing, numeric
from spanmill.operators import metric, resampling, shrinkage, splits, study


def test_counter_draw_of_the_published_vector(spark):
    digest = F.sha2(F.lit("match_bootstrap_v1|1729|0|10|A|0|0"), 256)
    row = spark.range(1).select(hashing.leading_uint64(digest).alias("v"), hashing.counter_draw([F.lit(x) for x in ("match_bootstrap_v1", 1729, 0, 10, "A", 0)], F.lit(2)).alias("i")).first()
    assert int(row.v) == 15729659965368872146 and row.i == 0


def test_draw_plan_keeps_stratum_sizes_and_any_order(spark):
    units = spark.range(37).select(F.col("id").alias("unit"), (F.col("id") % 3).alias("s"))
    plan = lambda df: sorted(tuple(r) for r in resampling.draw_plan(df, "unit", ["s"], 4, 1, "t").collect())
    rows = plan(units)
    assert rows == plan(units.orderBy(F.desc("unit")).repartition(3))
    for rep in range(4):
        for s in range(3):
            assert sum(m for r, st, _, m in rows if (r, st) == (rep, s)) == len(range(s, 37, 3))


def test_numbering_and_resample_means(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.col("id").cast("double").alias("v"))
    numbered, n = resampling.number_rows(df, ["k"])
    assert n == 500 and sorted((r["k"], r["_i"]) for r in numbered.collect()) == [(i, i) for i in range(500)]
    means = [r["mean"] for r in resampling.resample_means(df, "v", ["k"], 30, 0).collect()]
    assert len(means) == 30 and abs(np.mean(means) - 249.5) < 10
    assert resampling.number_rows(df.limit(0), ["k"])[1] == 0


def test_interval_positions_and_quantiles(spark):
    df = spark.range(1, 201).select(F.col("id").cast("double").alias("m"))
    r = resampling.interval(df, "m").first()
    assert (r.ci_low, r.ci_high, r.n_resamples) == (6.0, 195.0, 200)
    q = resampling.quantiles(df.withColumn("g", F.lit(1)), "m", ["g"], [0.1, 0.5]).first()
    assert (q.q0, q.q1) == (np.quantile(range(1, 201), 0.1), 100.5)


def test_clusters_and_unmapped(spark):
    df = spark.createDataFrame([(c, float(c)) for c in range(5) for _ in range(c + 1)], "c long, v double")
    assert resampling.cluster_resample(df, "v", "c", 10, 0).count() == 10
    with pytest.raises(Exception, match="no cluster"):
        resampling.cluster_resample(df.union(spark.createDataFrame([(None, 1.0)], df.schema)), "v", "c", 2, 0).collect()


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 9.0)], "g string, v double")
    got = sorted((r.g, -1 if r.v is None else r.v, r.percentile) for r in resampling.percentiles(df, "v", ["g"]).collect() if r.v is not None)
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 50.0), ("a", 2.0, 50.0), ("a", 4.0, 100.0), ("b", 9.0, 50.0)]


def test_summaries_need_enough_replicates(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(10)] + [("y", 1.0), ("y", None)], "k string, v double")
    got = {r.k: r for r in resampling.summarize_replicates(df, "v", ["k"], 5).collect()}
    assert got["x"].status == "available" and got["x"].median == 4.5 and got["y"].status == "insufficient" and got["y"].ci_low is None and got["y"].n_valid == 1


def test_chance_and_null(spark):
    pools = spark.createDataFrame([(i, 4) for i in range(50)], "id long, pool_size long")
    level = pools.agg(resampling.chance_level(pools).alias("c")).first().c
    assert level == pytest.approx((1 + 1 / 2 + 1 / 3 + 1 / 4) / 4)
    r = resampling.random_null(pools, ["id"], 0.99, 60, 0).first()
    assert abs(r.null_mean - level) < 0.03 and r.p_value == pytest.approx(1 / 61)


def test_shrinkage(spark):
    rows = [(1, 8, 10), (2, 2, 10), (3, 0, 0), (4, 5, 10)]
    df = spark.createDataFrame(rows, "id long, r__successes long, r__attempts long").withColumn("r", numeric.safe_ratio(F.col("r__successes"), F.col("r__attempts")))
    x = np.array([0.8, 0.2, 0.5])
    m, v = x.mean(), x.var(ddof=1)
    c = m * (1 - m) / v - 1
    got = {r.id: r.r for r in shrinkage.shrink(df, ["r"]).collect()}
    assert got[1] == pytest.approx((8 + m * c) / (10 + c)) and got[3] == pytest.approx(m)
    flat = shrinkage.beta_priors(df.where("id = 1"), ["r"]).first()
    assert tuple(flat) == (1.0, 1.0)
    assert shrinkage.movement(df, shrinkage.shrink(df, ["r"]), ["id"], ["r"]).first().max_shift > 0


def test_splits(spark):
    players = spark.range(400).select(F.col("id").alias("player_id"), F.concat(F.lit("r"), F.col("id") % 4).alias("role"))
    rows = splits.assign_splits(players, seed=3).collect()
    by_role = {}
    for r in rows:
        by_role.setdefault(r.role, []).append(r)
    for role, members in by_role.items():
        order = sorted(members, key=lambda r: (hashlib.sha256(f"3:{r.player_id}".encode()).hexdigest(), r.player_id))
        assert [r.split for r in order] == ["train"] * 60 + ["validation"] * 20 + ["test"] * 20, role
    with pytest.raises(Exception, match="several rows"):
        splits.assign_splits(players.union(players)).collect()


def test_agreement(spark):
    rows = [(u, float(v)) for u, vs in enumerate([[1, 2], [4, 5]]) for v in vs] + [(9, 3.0), (8, None)]
    assert study.krippendorff_alpha(spark.createDataFrame(rows, "u long, v double"), "u", "v").first().alpha == pytest.approx(0.85)
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "u long, v double")
    assert study.krippendorff_alpha(same, "u", "v").first().alpha == 1.0


def test_wilcoxon(spark):
    r = study.wilcoxon(spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(0.0,)], "d double"), "d").first()
    assert r.w == 55 and r.n == 10 and r.p_value < 0.05
    none = study.wilcoxon(spark.createDataFrame([(0.0,)], "d double"), "d").first()
    assert (none.w, none.z, none.p_value, none.n) == (0.0, 0.0, 1.0, 0)
    assert [study.decide(*a) for a in ((0.3, 1, 0, 1), (0.5, 1, 0.01, -1), (0.5, 1, 0.01, 1), (0.5, 0, 0.01, 1))] == ["REDESIGN", "NO-GO", "GO", "NO-GO"]


def test_gradients_numerically():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 1, 4)), rng.normal(size=(3, 5, 4))
    w = rng.uniform(0.5, 2, 4)
    _, g = metric.diagonal_loss(a, b, w, 0.5)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert g[i] == pytest.approx((metric.diagonal_loss(a, b, w + e, 0.5)[0] - metric.diagonal_loss(a, b, w - e, 0.5)[0]) / 2e-6, rel=1e-4, abs=1e-6)
    net = metric.init_network(4, 6, 3, 1)
    _, g = metric.network_loss(a, b, net, 0.5)
    at = 0
    for k, v in net.items():
        i = random.Random(k).randrange(v.size)
        out = []
        for d in (1e-6, -1e-6):
            moved = {n: x.copy() for n, x in net.items()}
            moved[k].ravel()[i] += d
            out.append(metric.network_loss(a, b, moved, 0.5)[0])
        assert g[at + i] == pytest.approx((out[0] - out[1]) / 2e-6, rel=1e-3, abs=1e-5)
        at += v.size


def test_training_improves(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(24, 4))
    noise = lambda: base * [1, 1, 0, 0] + rng.normal(size=(24, 4)) * [0.1, 0.1, 1, 1]
    q, c = (spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(noise())], "id long, role long, v array<double>") for _ in range(2))
    triples = metric.training_triples(q, c, "id", "role", 4)
    rows = triples.collect()
    assert len(rows) == 24 and all(len(r.negatives) == 4 for r in rows)
    fit = metric.train_diagonal(triples, 4, 0.01, iterations=8)
    assert fit.history[-1] < fit.history[0] and fit.weights.mean() == pytest.approx(1) and fit.weights[:2].min() > fit.weights[2:].max()
    net, best = metric.train_network(triples, 4, 6, 3, lambda n: -metric.network_loss(*metric._arrays(triples.toArrow()), n, 0.1)[0], epochs=4)
    assert metric.embed(q, net).first().v is not None and best > -1e9


def test_triples_against_plain_rings(spark):
    n, k = 300, 5
    rows = [(i, None if i % 50 == 49 else i % 3 if i < 290 else i, [float(i)]) for i in range(n)]
    q = spark.createDataFrame(rows, "id long, role long, v array<double>")
    made = {r.id: [x[0] for x in r.negatives] for r in metric.training_triples(q, q, "id", "role", k).collect()}
    scopes = {i: role for i, role, _ in rows}
    # an entity without scope, or alone in it, has no others
    assert sorted(made) == [i for i in range(290) if scopes[i] is not None]
    for i, others in made.items():
        assert len(others) == len(set(others)) == k and i not in others and all(scopes[int(x)] == scopes[i] for x in others)
    ring = metric._places(q.where("role IS NOT NULL").drop("v"), "id", "role", 0, parts=8).collect()
    for role in {r.role for r in ring}:
        assert sorted(r._place for r in ring if r.role == role) == list(range(sum(s == role for s in scopes.values())))
    followed = {(r.role, r._place): r.id for r in ring}
    size = {role: sum(s == role for s in scopes.values()) for role in (0, 1, 2)}
    starts = {r.id: r.h for r in q.select("id", F.xxhash64(F.lit(0), F.lit("start"), "id").alias("h")).collect()}
    for i, others in made.items():
        m = size[scopes[i]]
        assert others == [float(x) for x in (followed[scopes[i], (starts[i] % m + j) % m] for j in range(k + 1)) if x != i][:k]


def test_diagonal_training_is_whole(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, size, steps = 12, 64, 3
    base = rng.normal(size=(n, size))
    half = [base + rng.normal(size=(n, size)) * 0.7 for _ in range(2)]
    a, b = (spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(h)], "entity long, role long, v array<double>") for h in half)
    rows = queries._diagonal_training(spark, a, b, iterations=steps).collect()
    triples = metric.training_triples(a, b, "entity", "role").toArrow()
    assert {len(x) for x in triples["negatives"]} == {32}
    x, y = metric._arrays(triples)
    w, pull = np.ones(size), 2 * 0.5 * 0.1 / size
    for _ in range(steps):
        _, g = metric.diagonal_loss(x, y, w, 0.1)
        w = np.maximum((w - 0.5 * g / n + pull) / (1 + pull), 0)
        w *= size / w.sum()
    got = {r.feature: r.weight for r in rows if r.feature is not None}
    assert [got[i] for i in range(size)] == pytest.approx(w.tolist(), abs=1e-9) and len(got) == size
    s = np.array([[metric.diagonal_scores(p, q, w) for q in half[1]] for p in half[0]])
    want = {i: int(1 + (s[i] > s[i, i]).sum()) for i in range(n)}
    assert {r.entity: r.rank for r in rows if r.entity is not None} == want and {r.pool_size for r in rows if r.entity is not None} == {n}
    out = spark.range(24).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1))).alias("embedding"))
    out.write.parquet(str(tmp_path / "embeddings.parquet"))
    made = queries.diagonal_training(spark, str(tmp_path)).collect()
    assert sorted(r.feature for r in made if r.feature is not None) == list(range(64)) and sorted(r.entity for r in made if r.entity is not None) == list(range(12))


def test_assignment_digest_over_ranges(spark):
    rows = [(i * 7919 % 1009, random.Random(i).choice(["train", "test"])) for i in range(1009)]
    made = spark.createDataFrame(rows, "player_id long, split string")
    want = hashlib.sha256("".join(f"{i}:{s}\n" for i, s in sorted(rows)).encode()).hexdigest()
    assert {splits.assignment_digest(made, task_rows=n).first().digest for n in (100, 250_000)} == {want}
    assert splits.assignment_digest(made.limit(0)).first().digest == hashlib.sha256(b"").hexdigest()


def test_tree_digest_is_that_of_its_ranges(spark):
    rows = [(i * 7919 % 2503, random.Random(i).choice(["train", "test"])) for i in range(2503)]
    made = spark.createDataFrame(rows, "player_id long, split string").repartition(5)
    level = [(i, f"{i}:{s}\n") for i, s in sorted(rows)]
    for _ in range(3):
        groups = {}
        for i, text in level:
            groups.setdefault(i // 1000, []).append(text)
        level = [(i, hashlib.sha256("".join(t).encode()).hexdigest()) for i, t in groups.items()]
    assert splits.assignment_tree_digest(made).first().digest == hashlib.sha256("".join(t for _, t in level).encode()).hexdigest()
    assert splits.assignment_tree_digest(made.limit(0)).first().digest == hashlib.sha256(b"").hexdigest()


def test_normal_tails(spark):
    xs = [0.0, 1e-9, 0.1, 0.7, 1.5, 2.4999, 2.5, 3.0, 5.0, 10.0, 26.0, 40.0]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", numeric.erfc(F.col("x")).alias("e")).orderBy("i").collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-11, abs=1e-14)


def test_intervals_take_all_resamples(spark):
    rows = queries.replicate_intervals(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r.n_valid for r in rows) == 500
    assert all((r.status == "available") == (r.n_valid >= 450) == (r.ci_low is not None) for r in rows)


def test_imputed_values_are_ranked_without_a_percentile(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("a", 3.0, True), ("b", 5.0, True), ("a", None, True)], "g string, v double, known boolean")
    got = {(r.g, r.v): r.percentile for r in resampling.percentiles(rows, "v", ["g"], valid="known").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 2.0): None, ("a", 3.0): 100.0, ("b", 5.0): 50.0, ("a", None): None}


def test_replicate_percentiles_and_observed_neighbors(spark):
    from spanmill.plans import uncertainty

    rows = [(0, "x", 1, "A", 1.0), (0, "x", 1, "B", 3.0), (0, "x", 2, "A", None), (0, "x", 2, "B", 4.0), (1, "x", 1, "A", 7.0)]
    profiles = spark.createDataFrame(rows, "replicate int, role string, player_id int, period string, f double")
    got = {(r.replicate, r.player_id, r.period): r.percentile for r in uncertainty.replicate_percentiles(profiles, ["f"], ["player_id"]).collect()}
    assert got == {(0, 1, "A"): 0.0, (0, 1, "B"): pytest.approx(200 / 3), (0, 2, "A"): None, (0, 2, "B"): 100.0, (1, 1, "A"): 50.0}
    people = spark.createDataFrame([(i, i // 2, "r", [1.0, float(i)]) for i in range(8)], "entity int, human int, role string, v array<double>")
    near = uncertainty.observed_neighbors(people, people, ["entity"], "human", "role", 5).where("entity = 0").orderBy("rank").collect()
    assert [r.neighbor_entity for r in near] == [2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="fewer neighbours"):
        uncertainty.observed_neighbors(people, people, ["entity"], "human", "role", 7).collect()
