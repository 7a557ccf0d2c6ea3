from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import hashing, text
from spanmill.operators import quality, resampling, study
from spanmill.plans import experiments, publication, uncertainty

SUMMARY = "key int, status string, n_valid long, lo double, hi double, rate double"


def test_counter_draws_against_integers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, 7, 1000, (1 << 31) + 11, (1 << 40) - 87, 1 << 40])) for i in range(300)]
    out = spark.createDataFrame(rows, "i long, n long").select("i", "n", hashing.counter_draw([F.lit("t"), F.col("i")], F.col("n")).alias("d")).collect()
    for r in out:
        value = int.from_bytes(hashlib.sha256(f"t|{r.i}|0".encode()).digest()[:8], "big")
        assert value < 2**64 - 2**64 % r.n and r.d == value % r.n


def test_counter_draw_of_too_many_stops(spark):
    with pytest.raises(Exception, match="rejection limit"):
        spark.range(1).select(hashing.counter_draw([F.col("id")], F.lit((1 << 40) + 1))).collect()


def test_support(spark):
    rows = spark.createDataFrame([("r", 90, 3, 4), ("x", 90, 3, 4), ("r", 90, None, 4)], "f string, m int, hit int, miss int")
    out = rows.select(publication.support(F.col("f"), F.col("m"), {"r": ("hit", ("hit", "miss"))}).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in out] == [(90, 7, 3), (90, None, None), (90, None, None)]


def _attached(spark, rows, summaries):
    left = spark.createDataFrame(rows, "key int, name string")
    blocks = publication.attach_uncertainty(left, spark.createDataFrame(summaries, SUMMARY), ["key"], {"ci": ("lo", "hi")}, ["rate"], representation="rep")
    return {r.key: r.uncertainty.asDict() for r in blocks.collect()}


def test_uncertainty_blocks(spark):
    out = _attached(spark, [(1, "a"), (2, None), (3, "c")], [(1, "available", 500, 0.1, 0.2, 0.5), (2, "insufficient", 10, 0.1, 0.2, 0.5), (3, "available", 500, None, 0.2, None), (9, "available", 1, 0.0, 0.0, 0.0)])
    assert out[1] == {"status": "available", "valid_resamples": 500, "ci": [0.1, 0.2], "rate": 0.5, "representation_id": "rep"}
    assert out[2] == {"status": "insufficient", "valid_resamples": 10, "ci": None, "rate": None, "representation_id": "rep"}
    assert out[3]["ci"] is None and out[3]["rate"] is None
    assert _attached(spark, [], []) == {}


@pytest.mark.parametrize("summaries, message", [([], "no uncertainty"), ([(1, "available", 5, 0.0, 1.0, 0.0)] * 2, "two summaries"), ([(1, "pending", 5, 0.0, 1.0, 0.0)], "unexpected status"), ([(1, None, 5, 0.0, 1.0, 0.0)], "unexpected status")])
def test_uncertainty_faults_stop(spark, summaries, message):
    with pytest.raises(Exception, match=message):
        _attached(spark, [(1, "a")], summaries)


def test_caveats(spark):
    rows = spark.createDataFrame([("Goalkeeper", "available"), ("Forward", "pending"), (None, None)], "role string, status string")
    out = [[c.code for c in r[0]] for r in rows.select(publication.profile_caveats(F.col("role"), F.col("status"))).collect()]
    assert out[0][4:] == ["uncertainty_sampling_only", "goalkeeper_feature_coverage_weak"] and out[1][4:] == out[2][4:] == ["uncertainty_pending"]


def test_weights_and_digests():
    assert publication.weight_vector({"b": 0.5, "a": 2}, ["c"], ["a", "b", "c"]) == [2.0, 0.5, 0.0]
    with pytest.raises(ValueError, match="weighted and excluded"):
        publication.weight_vector({"a": 1}, ["a"], ["a"])
    with pytest.raises(ValueError, match="neither"):
        publication.weight_vector({"a": 1}, [], ["a", "b"])
    made = publication.representation({"a": 0.1234567890123456, "b": 1}, ["b", "a"])
    assert made["weight_digest"] == hashlib.sha256(b'[["b",1.0],["a",0.123456789012]]').hexdigest()
    assert made["feature_order_digest"] == hashlib.sha256(b'["b","a"]').hexdigest()


def test_binding_and_reconstruction(spark):
    docs = [("a", '{"x": {"representation_id": "r1"}}'), ("b", '{"representation_id":"r2","y":[{"representation_id":"r1"}]}'), ("c", "{}"), ("d", None)]
    faults = publication.binding_faults(spark.createDataFrame(docs, "path string, document string"), "r1")
    assert sorted(map(tuple, faults.collect()), key=str) == [("b", "r2"), ("c", None), ("d", None)]
    parts = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.5)], "k int, weighted_contribution double")
    scores = spark.createDataFrame([(1, 0.75), (2, 0.6), (3, 0.1), (4, None)], "k int, score double")
    assert tuple(publication.reconstruction(parts, scores, ["k"]).first()) == ("contributions add up to the score", 3, 2, "fail")


def test_delta_summaries(spark):
    first = spark.createDataFrame([(i, 1 + i % 4) for i in range(12)], "e int, rank int")
    second = spark.createDataFrame([(i, 1 + i % 3) for i in range(12)], "e int, rank int")
    deltas = [1 / (1 + i % 3) - 1 / (1 + i % 4) for i in range(12)]
    row = experiments.delta_summary(first, second, ["e"], 200).first()
    assert row.point_estimate == pytest.approx(sum(deltas) / 12) and row.n_queries == 12 and row.n_resamples == 200 and row.ci_low <= row.point_estimate <= row.ci_high
    clusters = spark.createDataFrame([(i, i // 4) for i in range(12)], "e int, cluster int")
    row = experiments.delta_summary(first, second, ["e"], 200, clusters=clusters).first()
    assert row.n_clusters == 3 and row.point_estimate == pytest.approx(sum(deltas) / 12) and row.ci_low <= row.ci_high
    with pytest.raises(Exception, match="no cluster"):
        experiments.delta_summary(first, second, ["e"], 20, clusters=clusters.where("e > 0")).collect()


def test_absent_candidates_come_last(spark):
    """Against the definition: score -inf for absent candidates, ties by identity."""
    rng = random.Random(8)
    cohort = [(i, i % 2) for i in range(8)]
    here = [(r, i, p) for r in range(6) for i, _ in cohort for p in "AB" if rng.random() < 0.6 and r < 5]
    there = {(r, i) for r, i, p in here if p == "B"}
    asks = {(r, i) for r, i, p in here if p == "A"}
    score = {(r, q, c): rng.randrange(5) for r in range(6) for q, _ in cohort for c, _ in cohort}
    for role in (None, "role"):
        expected, ranks = {}, []
        for r in range(6):
            for q, part in cohort:
                pool = [c for c, other in cohort if role is None or other == part]
                s = lambda c: score[r, q, c] if (r, c) in there else float("-inf")  # noqa: B023, E731
                rank = 1 + sum(s(c) > s(q) or (s(c) == s(q) and c < q) for c in pool)
                expected[r, q] = rank if (r, q) in asks and any((r, c) in there for c in pool) else None
                if (r, q) in asks and (r, q) in there:
                    ranks.append((r, q, 1 + sum((r, c) in there and (s(c) > s(q) or (s(c) == s(q) and c < q)) for c in pool)))
        out = uncertainty.with_absent(
            spark.createDataFrame(ranks, "replicate int, e int, rank int"), spark.createDataFrame(here, "replicate int, e int, period string"), spark.createDataFrame(cohort, "e int, role int"), "e", 6, role
        )
        assert {(x.replicate, x.e): x["rank"] for x in out.collect()} == expected


def test_rank_summaries(spark):
    rows = [(1, r) for r in [1, 2, 5, 6, None]] + [(2, 3)]
    out = {r.e: r for r in resampling.summarize_ranks(spark.createDataFrame(rows, "e int, rank int"), ["e"], 4).collect()}
    assert (out[1].n_valid, out[1].median_rank, out[1].rate_at_1, out[1].rate_at_5, out[1].status) == (4, 3.5, 0.25, 0.75, "available")
    assert out[1].rank_low == pytest.approx(1.075) and out[1].rank_high == pytest.approx(5.925)
    assert (out[2].n_valid, out[2].median_rank, out[2].rank_low, out[2].status) == (1, None, None, "insufficient")


def test_sheet_is_blind_and_whole(spark):
    arms = spark.createDataFrame([(q, c, "abc"[c % 3]) for q in range(3) for c in range(9)], "query int, candidate int, arm string")
    sheet, key = study.rating_sheet(arms, "query", 1)
    assert sheet.columns == ["query", "position", "candidate"]
    joined = sheet.join(key, ["query", "position"]).select("query", "candidate", "arm")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, arms.collect()))
    shown = study.cards(sheet, spark.createDataFrame([(0, 12.6, 0.12345)], "player int, minutes_played double, s double"), "player", ["s"]).where("query = 0").collect()
    assert len(shown) == 9 and {(r.minutes_played, r.s) for r in shown if r.candidate == 0} == {(13.0, 0.123)} and all(r.s is None for r in shown if r.candidate)


def test_coverage_sets_and_natural_order(spark):
    used = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["c", None],)], "tags array<string>")
    row = quality.coverage(used, "tags", spark.createDataFrame([("a",)], "t string"), "t", "tags").first()
    assert (row.n_checked, row.n_bad, row.samples) == (3, 2, ["b", "c"])
    a, b = (spark.createDataFrame(x, "v int") for x in ([(1,), (1,), (None,)], [(None,), (2,)]))
    assert tuple(quality.same_set(a, b, "v").first()) == ("same_set(v)", 3, 2, "fail")
    assert quality.same_set(a, a.distinct(), "v").first().status == "ok"
    names = ["a10", "A2", "a02b", "a", "10", "9", "007", ""]
    ordered = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()]
    assert ordered == ["", "007", "9", "10", "a", "A2", "a02b", "a10"]
