"""Ranks and neighbours by blocks of both sides: no pair leaves a task."""

from __future__ import annotations

import numpy as np
import pytest

from spanmill.operators import blocks, retrieval


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)


def sides(spark, n=60):
    """Vectors in copies, a zero one, one null and one with a NaN, with a team that is null at times."""
    rng = np.random.default_rng(1)
    a, b = (np.tile(rng.normal(size=(n // 3, 4)).round(2), (3, 1)) for _ in range(2))
    b[5] = 0
    b[6, 1] = np.nan
    team = [None if i % 11 == 0 else i % 4 for i in range(n)]
    rows = lambda m: [(i, team[i], float(i % 7), None if i == 8 else [float(x) for x in v]) for i, v in enumerate(m)]
    schema = "id long, team long, minutes double, v array<double>"
    b[8] = a[8] = 0
    return a, b, team, spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema)


def scores(a, b):
    size = lambda m: np.linalg.norm(m, axis=1)
    root = np.outer(size(a), size(b))
    with np.errstate(invalid="ignore"):
        return np.where(root == 0, 0, np.round((a @ b.T) / np.where(root == 0, 1, root), 6))


def first(s, i, allowed):
    """Candidates of query i, the best first; NaN comes last."""
    return sorted(allowed, key=lambda j: (np.isnan(s[i, j]), -s[i, j] if s[i, j] == s[i, j] else 0, j))


def test_ranks_over_many_blocks(spark, small_blocks):
    a, b, team, q, c = sides(spark)
    s, n = scores(a, b), len(a)
    out = retrieval.vector_ranks(q, c, ["id"], digits=6)
    got = {r.id: (r["rank"], r.pool_size) for r in out.collect()}
    assert got == {i: (first(s, i, range(n)).index(i) + 1, n) for i in range(n)}
    assert "CoGroups" in out._jdf.queryExecution().toString()
    got = {r.id: (r["rank"], r.pool_size) for r in retrieval.vector_ranks(q, c, ["id"], digits=6, scope="team").collect()}
    pool = lambda i: [j for j in range(n) if team[j] == team[i]]
    assert got == {i: (first(s, i, pool(i)).index(i) + 1, len(pool(i))) for i in range(n) if team[i] is not None}
    got = {r.id: (r["rank"], r.pool_size) for r in retrieval.vector_ranks(q, c, ["id"], digits=6, apart="team").collect()}
    pool = lambda i: [j for j in range(n) if j == i or None not in (team[i], team[j]) and team[i] != team[j]]
    assert got == {i: (first(s, i, pool(i)).index(i) + 1, len(pool(i))) for i in range(n)}


def test_neighbours_over_many_blocks(spark, small_blocks):
    a, b, team, q, c = sides(spark)
    s, n = scores(a, b), len(a)
    for k in (3, 25, 80):
        rows = retrieval.top_neighbors(q, c, ["id"], k, digits=6).orderBy("id", "rank").collect()
        got = {i: [r.neighbor_id for r in rows if r.id == i] for i in range(n)}
        assert got == {i: first(s, i, range(n))[:k] for i in range(n)}
    rows = retrieval.top_neighbors(q, c, ["id"], 4, digits=6, human="team").orderBy("id", "rank").collect()
    other = lambda i: [j for j in range(n) if None not in (team[i], team[j]) and team[i] != team[j]]
    assert {i: [r.neighbor_id for r in rows if r.id == i] for i in range(n)} == {i: first(s, i, other(i))[:4] for i in range(n)}


def test_attributes_then_minutes_over_many_blocks(spark, small_blocks):
    _, _, team, q, c = sides(spark)
    n = len(team)
    key = lambda i, j: (team[i] is None or team[i] != team[j], abs(i % 7 - (j + 1) % 7), j)
    moved = c.selectExpr("id", "team", "cast((id + 1) % 7 as double) as minutes")
    got = {r.id: (r["rank"], r.pool_size) for r in retrieval.profile_ranks(q.drop("v"), moved, ["id"], ["team"]).collect()}
    assert got == {i: (sorted(range(n), key=lambda j, i=i: key(i, j)).index(i) + 1, n) for i in range(n)}


def test_signed_ranks_of_many_equal_differences(spark):
    from spanmill.operators import study

    r = study.wilcoxon(spark.range(3_000_000).selectExpr("cast(if(id % 3 = 0, -1, 1) as double) as d"), "d").first()
    n = 3e6
    gap = 2e6 * (n + 1) / 2 - n * (n + 1) / 4
    assert r.n == 3_000_000 and r.w == 2e6 * (n + 1) / 2
    assert r.z == pytest.approx((gap - 0.5) / (n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48) ** 0.5)


def test_draw_lists_are_not_broadcast(spark):
    from spanmill.plans import replicates

    units = spark.range(40).selectExpr("id as match_id", "id % 2 as s")
    lists = replicates.draw_lists(units, "match_id", ["s"], 5, 1, "d")
    sums = replicates.replicate_sums(units.selectExpr("match_id", "s as player", "1.0 as x"), lists, "match_id", ["player"], ["x"], 5)
    plan = sums._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "match_id" in line]


def test_random_null_is_dealt_over_tasks(spark):
    from spanmill.functions.hashing import counter_draw
    from spanmill.operators import resampling
    from pyspark.sql import functions as F

    pools = spark.range(50).selectExpr("id as player_id", "id % 7 + 1 as pool_size").coalesce(1)
    out = resampling.random_null(pools, ["player_id"], 0.5, 200, 5)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    tries = pools.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199))))
    rank = counter_draw([F.lit("null"), F.lit(5), F.col("r"), F.col("player_id")], F.col("pool_size")) + 1
    mrr = tries.groupBy("r").agg(F.avg(1.0 / rank).alias("m"))
    want, got = mrr.agg(F.avg("m"), F.percentile("m", F.lit(0.95)), (F.count_if(F.col("m") >= 0.5) + 1) / 201).first(), out.first()
    assert list(got)[:3] == pytest.approx(list(want)) and got.n_permutations == 200


def test_evidence_of_every_pair_of_a_role(spark):
    from spanmill import queries

    queries_of, rows = queries._population(spark, "/root/testdata/sf0.01"), queries.score_evidence(spark, "/root/testdata/sf0.01")
    sizes = queries_of.queries.groupBy("role").count().join(queries_of.candidates.groupBy("role").count().withColumnRenamed("count", "c"), "role")
    assert rows.count() == 6 * sum(r["count"] * r.c for r in sizes.collect()) and "WindowExec" not in rows._jdf.queryExecution().toString()


def test_evidence_of_a_pair_is_compiled(spark):
    from spanmill.operators import evidence

    pairs = spark.createDataFrame([(1, [3.0, -0.0], [1.0, 2.0], 3.0, 2.0), (2, [None, 1.0], [1.0, float("nan")], 1.0, 1.0), (3, [0.0, 0.0], [1.0, 1.0], 0.0, 1.0)], "id long, qv array<double>, cv array<double>, qn double, cn double")
    rows = evidence.contributions(pairs, ["a", "b"], {})
    got = {(r.id, r.feature_id): (r.place, r.contribution) for r in rows.collect()}
    assert got[1, "a"] == (1, 0.5) and got[1, "b"] == (2, 0.0) and got[2, "a"] == (2, None) and got[2, "b"][0] == 1 and got[3, "a"] == (1, 0.0) and got[3, "b"] == (2, 0.0)
    assert "lambda" not in spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")


def test_digits_of_a_batch_give_the_value(spark):
    from fractions import Fraction

    from spanmill.functions import exact

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200), [5e-324, -5e-324, 1.7976931348623157e308, 0.0, -0.0, 1 / 3]])
    total = [Fraction(0)] * len(x)
    for at, k, d in exact._digits(x):
        assert (np.abs(d) < 1 << 24).all()
        for i, power, digit in zip(at.tolist(), k.tolist(), d.tolist()):
            total[i] += Fraction(digit) * Fraction(2) ** (24 * power)
    assert total == [Fraction(float(v)) for v in x]


def test_packed_triples_keep_their_numbers(spark):
    from spanmill.operators import metric

    rows = [([float(i), 1.0], [2.0, float(i)], [[float(i + j), 0.5] for j in range(3)]) for i in range(5)]
    triples = spark.createDataFrame(rows, "anchor array<double>, positive array<double>, negatives array<array<double>>").coalesce(1)
    got = [metric._unpacked(r.asDict()) for r in metric.packed(triples).collect()]
    a, b = (np.concatenate(p) for p in zip(*got))
    assert a.tolist() == [[r[0]] for r in rows] and b.tolist() == [[r[1], *r[2]] for r in rows]


def test_profiles_of_periods_read_lines_once_and_are_scaled_once(spark):
    from spanmill import queries, queries_more

    for name in ("provider_period_profiles", "provider_period_profiles_2"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_linenumber#") and plan.count("Aggregate [") == 1, name
    p = queries_more._population(spark, "/root/testdata/sf0.001")
    for side in (p.queries, p.candidates):
        assert "Aggregate" not in side._jdf.queryExecution().optimizedPlan().toString()


def test_searched_ranks_agree_with_every_pair():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for size in (1, 2, 30, 90):
        c, q = rng.choice([0.1, 0.2, 0.3, 1e16, np.nan, np.inf, -np.inf, 4.0], size), rng.choice([0.1, 0.3, np.nan, np.inf, 1.0], size)
        with np.errstate(invalid="ignore"):
            gap = np.abs(c - q)
            far = np.abs(q[:, None] - c[None, :])
        values = [pa.chunked_array([pa.array([None if x == 2 else int(x) for x in rng.integers(0, 3, size)], pa.int64())]) for _ in range(4)]
        codes = [blocks._codes(a, b) for a, b in zip(values[:2], values[2:])]
        qp, cp = rng.permutation(2 * size)[:size], np.arange(size) * 2
        unequal = (codes[0][0][:, None] != codes[0][1][None, :]) * 2 + (codes[1][0][:, None] != codes[1][1][None, :])
        for level in range(4):
            want = (unequal < level) | (unequal == level) & ((far < gap[:, None]) | (far == gap[:, None]) & (cp[None, :] < qp[:, None]))
            got = np.zeros(size, np.int64)
            for lower in range(level + 1):
                for sign, equal in blocks._parts(lower, 2):
                    met, closer = blocks._nearer(np.arange(size), [codes[k] for k in equal], q, c, gap, qp, cp)
                    got += sign * (met if lower < level else closer)
            assert got.tolist() == want.sum(1).tolist()


def test_draws_of_resampled_means_are_dealt_over_tasks(spark):
    from spanmill.functions.hashing import counter_draw
    from spanmill.operators import resampling
    from pyspark.sql import functions as F

    values = spark.range(40).selectExpr("id", "cast(id * id as double) as x").coalesce(1)
    out = resampling.resample_means(values, "x", ["id"], 30, 7)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    draw = counter_draw([F.lit("paired"), F.lit(7), F.col("replicate"), F.col("id")], F.lit(40))
    draws = values.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("replicate", draw.alias("i"))
    want = {r.replicate: r.m for r in draws.groupBy("replicate").agg(F.avg(F.col("i") * F.col("i")).alias("m")).collect()}
    assert {r.replicate: r["mean"] for r in out.collect()} == pytest.approx(want)


def test_eligible_profiles_are_computed_once(spark):
    from spanmill.plans import stand_in

    plan = stand_in.eligible(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "spanmill-" in stand_in.eligible(spark, "/root/testdata/sf0.001").inputFiles()[0]


def test_ranges_are_found_without_passing_over_all_cuts(spark):
    from spanmill.operators import resampling
    from pyspark.sql import functions as F

    rows = spark.range(5000).selectExpr("if(id % 97 = 0, null, id * 7919 % 3001) as x")
    for ranges in (1, 2, 5, 32, 33):
        dealt = resampling.ranged(rows, "x", ranges)
        assert "lambda" not in dealt._jdf.queryExecution().optimizedPlan().toString()
        cuts = rows.agg(F.array_distinct(F.percentile_approx("x", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(100 * ranges)))).first()[0] if ranges > 1 else []
        got = dealt.select("x", "_part").collect()
        assert all(r._part == (0 if r.x is None else sum(c <= r.x for c in cuts)) for r in got), ranges
