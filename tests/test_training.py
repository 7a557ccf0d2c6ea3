"""Triples that share their others."""

from __future__ import annotations

import numpy as np
import pytest

from spanmill.operators import metric


def test_shared_others_give_the_loss_of_each_triple(monkeypatch):
    rng = np.random.default_rng(0)
    a, u, places = rng.normal(size=(7, 5)), rng.normal(size=(12, 5)), rng.integers(0, 12, (7, 9))
    w = rng.random((5, 3)) + 0.1
    want = metric.arms_loss(a[:, None], u[places], w, 0.1)
    for most in (512, 3):
        monkeypatch.setattr(metric, "COMPARED", most)
        got = metric.shared_loss(a, u, places, w, 0.1)
        assert got[0] == pytest.approx(want[0], rel=1e-12) and got[1] == pytest.approx(want[1], rel=1e-9, abs=1e-9)


def test_packs_keep_a_shared_vector_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    q = spark.createDataFrame(rows, "id long, role long, v array<double>")
    triples = metric.training_triples(q, q, "id", "role", 32)
    packs = [r.asDict() for r in metric.packed(triples).collect()]
    assert sum(p["n"] for p in packs) == 600
    held = sum(len(p["others"]) for p in packs) // 32
    assert held < 600 * 33 / 5
    made = {tuple(a[0]): sorted(map(tuple, b[1:])) for p in packs for a, b in zip(*metric._unpacked(p))}
    assert made == {tuple(r.anchor): sorted(map(tuple, r.negatives)) for r in triples.collect()}
