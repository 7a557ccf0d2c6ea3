"""Exact sums, as-of and overlap joins, sketches, arms and replicate arrays against plain versions."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import exact
from spanmill.operators import joins, metric, resampling, sketches
from spanmill.plans import replicates


def test_exact_sums_like_fsum_on_any_partitioning(spark):
    rng = random.Random(1)
    groups = {}
    for g in range(40):
        n = rng.randint(1, 30)
        anything = lambda: struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        groups[g] = [
            [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(n)], [x for x in (anything() for _ in range(n)) if math.isfinite(x) and abs(x) < 1e300] or [0.0],
            [1.0, 2**-53, 2**-106 * rng.choice([1, -1, 0])], [1e100, 1.0, -1e100, rng.random()], [5e-324 * rng.randint(-9, 9) for _ in range(n)], [round(rng.uniform(-1000, 1000), 2) for _ in range(n)],
        ][g % 6]
    groups |= {100: [1.0, 2**-53], 101: [1 + 2**-52, 2**-53], 102: [-0.0, 0.0], 103: [1.7976931348623157e308], 104: [2.0**53, 1.0, 1e-9], 105: [-1.0, -(2**-53), -1e-40]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
        got = {r.g: r.t for r in exact.exact_sums(df, ["g"], {"t": F.col("x")}).collect()}
        assert got == {g: math.fsum(xs) for g, xs in groups.items()}
    halves = [exact.partial_sums(df.where(F.col("x") < 0), ["g"], F.col("x")), exact.partial_sums(df.where(F.col("x") >= 0), ["g"], F.col("x"))]
    assert {r.g: r.total for r in exact.merge_sums(halves[0].union(halves[1]), ["g"]).collect()} == got


def test_exact_sums_of_what_is_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, nan), (2, inf), (2, 1.0), (3, inf), (3, -inf), (4, None), (5, 1.7e308), (5, 1.7e308), (6, -inf), (None, 2.0), (7, None), (7, 1.5)], "g int, x double")
    got = {r.g: r.t for r in exact.exact_sums(df, ["g"], {"t": F.col("x")}).collect()}
    assert math.isnan(got.pop(1)) and math.isnan(got.pop(3))
    assert got == {2: inf, 4: None, 5: inf, 6: -inf, None: 2.0, 7: 1.5}
    assert exact.exact_sums(df.where("g = 7"), [], {"t": F.col("x"), "u": -F.col("x")}).collect() == [(1.5, -1.5)]
    assert exact.exact_sums(df.where("false"), ["g"], {"t": F.col("x")}).collect() == []


def no_loops(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("strict,ranges", [(False, 1), (False, 5), (True, 40)])
def test_asof_like_a_plain_search(spark, strict, ranges):
    rng = random.Random(ranges)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)])) for i in range(150)] + [(7, 1, 5), (7, 1, 5)]
    right = [(rng.choice([1, 1, 2, 4, None]), rng.choice([None, *range(60)]), rng.randint(0, 9), "x") for _ in range(120)]
    a, b = spark.createDataFrame(left, "id long, k int, ts long"), spark.createDataFrame(right, "k int, ts long, v int, note string")
    for limit in (None, 4):
        got = joins.asof_join(a, b, "ts", ["k"], ranges=ranges, strict=strict, tolerance=None if limit is None else F.lit(limit)).collect()
        want = []
        for i, k, t in left:
            best = max(((u, v) for kk, u, v, _ in right if None not in (k, t, u) and kk == k and (u < t if strict else u <= t)), default=None)
            best = best if best and (limit is None or t - best[0] <= limit) else None
            want.append((i, k, t, *(best or (None, None)), "x" if best else None))
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert joins.asof_join(a.where("false"), b, "ts", ["k"]).count() == 0 and joins.asof_join(a, b.where("false"), "ts", ["k"]).where("right_v is not null").count() == 0
    assert no_loops(joins.asof_join(a, b, "ts", ["k"]))
    with pytest.raises(ValueError, match="prefix"):
        joins.asof_join(a, b, "ts", ["k"], prefix="")


def test_overlaps_like_all_pairs(spark):
    rng = random.Random(4)

    def intervals(n):
        out = []
        for i in range(n):
            a = rng.randint(-300, 300)
            out.append((i, rng.choice([1, 1, 2, None]), a, a + rng.choice([0, 0, 1, 3, 7, 8, 100, 900])))
        return out + [(n, 1, None, 3), (n + 1, 1, 3, None), (n + 2, 1, 5, 4), (n + 3, 1, -(10**12), 10**12)]

    left, right = intervals(80), intervals(60)
    a, b = (spark.createDataFrame(x, "id long, k int, a long, b long") for x in (left, right))
    got = sorted((r.id, r.right_id) for r in joins.overlap_join(a, b, "a", "b", ["k"]).collect())
    valid = lambda r: None not in r and r[2] <= r[3]
    assert got == sorted((p[0], q[0]) for p in left for q in right if valid(p) and valid(q) and p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    everything = joins.overlap_join(a, b, "a", "b")
    assert no_loops(everything) and no_loops(joins.matched(a, b, ["k", "id"], "a"))
    assert everything.count() == sum(p[2] <= q[3] and q[2] <= p[3] for p in left for q in right if None not in p[2:] + q[2:] and p[2] <= p[3] and q[2] <= q[3])
    assert joins.overlap_join(a.where("false"), b, "a", "b").count() == 0


def test_full_outer_with_null_keys(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (None, "y", 2.0), (3, None, 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 9.0), (None, "y", 8.0), (4, "z", 7.0)], "k int, s string, v double")
    got = sorted(map(tuple, joins.matched(a, b, ["k", "s"], "v").collect()), key=str)
    assert got == sorted([(1, "x", 1.0, 9.0, "both"), (None, "y", 2.0, 8.0, "both"), (3, None, 3.0, None, "left"), (4, "z", None, 7.0, "right")], key=str)


def test_merged_sketches_within_their_bounds(spark):
    rng = np.random.default_rng(0)
    ids, values = rng.integers(0, 30_000, 60_000), rng.exponential(size=60_000)
    items = np.where(rng.random(60_000) < 0.3, 7, rng.integers(0, 400, 60_000))
    rows = [(int(i % 5), int(i), float(v), int(x)) for i, v, x in zip(ids, values, items)]
    df = spark.createDataFrame(rows, "part int, id long, value double, item long").withColumn("whole", F.lit(1))
    merged = sketches.union(sketches.sketches(df, ["whole", "part"], "id", "value", "item"), ["whole"])
    n = len(set(ids.tolist()))
    q = [float(np.quantile(values, p)) for p in (0.1, 0.5, 0.9)]
    r = merged.select(sketches.n_distinct("distinct_sketch").alias("d"), sketches.n_in_set("set_sketch").alias("s"), sketches.frequent("item_sketch", 1).alias("top"), *(sketches.within_quantiles("value_sketch", p, F.lit(x), 0.02).alias(f"q{i}") for i, (p, x) in enumerate(zip((0.1, 0.5, 0.9), q)))).first()
    assert abs(r.d - n) < 0.08 * n and abs(r.s - n) < 0.05 * n and r.q0 and r.q1 and r.q2
    assert r.top[0]["item"] == 7 and abs(r.top[0]["count"] - int((items == 7).sum())) <= 60
    two = sketches.sketches(df, ["part"], "id", "value", "item").where("part < 2").agg(F.min_by("set_sketch", "part").alias("a"), F.max_by("set_sketch", "part").alias("b"))
    assert two.select(sketches.n_in_both(F.col("a"), F.col("b"))).first()[0] == 0


def test_arms_together_like_each_alone(spark):
    rng = np.random.default_rng(7)
    n, d, steps = 40, 6, 12
    half = [rng.normal(size=(n, d)) for _ in range(2)]
    a, b = (spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(h)], "entity long, role long, v array<double>") for h in half)
    triples = metric.training_triples(a, b, "entity", "role", 5)
    strengths = [0.0, 0.1, 10.0]
    fits = metric.train_arms(triples, d, strengths, iterations=steps, temperature=0.05)
    x, y = metric._arrays(triples.toArrow())
    for s in strengths:
        w, pull = np.ones(d), 2 * 0.5 * s / d
        for _ in range(steps):
            top, sa, sb = (x * y) @ w, (x * x) @ w, (y * y) @ w
            score = top / np.sqrt(sa * sb)
            p = np.exp(score / 0.05 - (score / 0.05).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[:, 0] -= 1
            g = p / 0.05
            grad = np.zeros(d)
            for i in range(d):
                ds = x[..., i] * y[..., i] / np.sqrt(sa * sb) - score / 2 * (x[..., i] ** 2 / sa + y[..., i] ** 2 / sb)
                grad[i] = (g * ds).sum() / len(x)
            w = np.maximum((w - 0.5 * grad + pull) / (1 + pull), 0)
            w *= d / w.sum()
        assert fits[s].weights == pytest.approx(w, abs=1e-9) and len(fits[s].history) == steps
    assert len(metric.train_arms(triples, d, [10.0], iterations=200, tolerance=1e-6)[10.0].history) < 200
    ranks = {(r.regularization, r.entity): r["rank"] for r in metric.arm_ranks(a, b, fits, "entity", "role").collect()}
    for s in strengths:
        u, v = (h * np.sqrt(fits[s].weights) for h in half)
        score = np.round((u @ v.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None], 9)
        for i in range(n):
            others = [j for j in range(n) if j % 2 == i % 2]
            assert ranks[s, i] == 1 + sum(score[i, j] > score[i, i] or (score[i, j] == score[i, i] and j < i) for j in others)


def test_draw_lists_are_the_draw_plan_and_arrays_its_sums(spark):
    rng = random.Random(5)
    units = spark.createDataFrame([(i, i % 3, "AB"[i % 2]) for i in range(60)], "match_id long, c long, period string")
    plan = {}
    for r in resampling.draw_plan(units, "match_id", ["c", "period"], 9, 1, "t").collect():
        plan[r.replicate, r.match_id] = r.multiplicity
    lists = replicates.draw_lists(units, "match_id", ["c", "period"], 9, 1, "t")
    held = {}
    for r in lists.collect():
        for x in r.drawn:
            held[x, r.match_id] = held.get((x, r.match_id), 0) + 1
    assert held == plan
    stats = [(rng.randint(0, 4), m, float(rng.randint(0, 9)), None if m % 7 == 0 else 1.0) for m in range(60) for _ in range(2)]
    sums = spark.createDataFrame(stats, "player long, match_id long, q double, o double")
    arrays = replicates.replicate_sums(sums, lists, "match_id", ["player", "period"], ["q", "o"], 9)
    want = {}
    for p, m, q, o in stats:
        for k in range(9):
            w = plan.get((k, m), 0)
            if w:
                at = want.setdefault((k, p, "AB"[m % 2]), [0.0, 0.0])
                at[0] += q * w
                at[1] += (o or 0) * w
    rows = {(r.replicate, r.player, r.period): [r.q, r.o] for r in replicates.as_rows(arrays, ["player", "period"], ["q", "o"]).collect()}
    assert rows == want


def test_neighbor_ranks_like_plain_ranks_with_absent_profiles(spark):
    rng = np.random.default_rng(3)
    n, reps = 14, 6
    value = rng.normal(size=(2, n, 2, reps))
    there = rng.random((2, n, reps)) < 0.7
    rows = [(i, i % 2, p, there[p, i].astype(float).tolist(), *(value[p, i, f].tolist() for f in range(2))) for p in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, role int, p int, drawn array<double>, f array<double>, g array<double>")
    chosen = [(i, (i + 2) % n) for i in range(n)] + [(i, (i + 4) % n) for i in range(n)]
    got = replicates.neighbor_ranks(df.where("p = 0"), df.where("p = 1"), spark.createDataFrame(chosen, "id long, neighbor long"), "id", "id", "role", ["f", "g"], reps)
    ranks = {(r.id, r.neighbor): r.ranks for r in got.collect()}
    for i, t in chosen:
        for r in range(reps):
            others = [j for j in range(n) if j % 2 == i % 2 and j != i]
            score = {}
            for j in others:
                u, v = value[0, i, :, r], value[1, j, :, r]
                score[j] = round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 6) if there[1, j, r] else -math.inf
            valid = there[0, i, r] and any(there[1, j, r] for j in others)
            assert ranks[i, t][r] == (1 + sum(s > score[t] or (s == score[t] and j < t) for j, s in score.items()) if valid else None)


    own = replicates.neighbor_ranks(df.where("p = 0"), df.where("p = 1"), spark.createDataFrame([(i, i) for i in range(n)], "id long, neighbor long"), "id", None, "role", ["f", "g"], reps)
    for r in own.collect():
        for k in range(reps):
            pool = [j for j in range(n) if j % 2 == r.id % 2]
            score = {j: round(float(value[0, r.id, :, k] @ value[1, j, :, k] / np.linalg.norm(value[0, r.id, :, k]) / np.linalg.norm(value[1, j, :, k])), 6) if there[1, j, k] else -math.inf for j in pool}
            valid = there[0, r.id, k] and any(there[1, j, k] for j in pool)
            assert r.ranks[k] == (1 + sum(s > score[r.id] or (s == score[r.id] and j < r.id) for j, s in score.items()) if valid else None)


def test_numbers_within_strata_and_of_strings(spark):
    rows = [(f"é{i % 97:03d}x", i % 3 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(sorted(set(rows), key=str), "u string, s int")
    got = resampling.stratum_numbers(df, "u", ["s"]).collect()
    for s in (0, 1, 2, None):
        own = sorted((r._i, r.u) for r in got if r.s == s)
        assert [i for i, _ in own] == list(range(len(own))) and [u for _, u in own] == sorted(u for _, u in own) and all(r._n == len(own) for r in got if r.s == s)
    numbered, n = resampling.number_rows(df.select("u").distinct(), ["u"])
    assert [r.u for r in sorted(numbered.collect(), key=lambda r: r._i)] == sorted(r.u for r in df.select("u").distinct().collect()) and n == numbered.count()
