"""Document walks, drift gates, frozen weights and clustered tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from spanmill.operators import documents, drift, frozen
from spanmill.sources import layout


def plain_walk(value, path="", pattern=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            dot = "." if path else ""
            yield from plain_walk(v, f"{path}{dot}{k}", f"{pattern}{dot}{k}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain_walk(v, f"{path}[{i}]", f"{pattern}[*]")
    else:
        yield path, pattern, value


def anything(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind == 5 or kind == 7:
        return {rng.choice("abcde"): anything(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if kind == 6:
        return [anything(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 7, "x", "", "[]", "é", "design"])


def test_walk_like_a_plain_one(spark):
    rng = random.Random(8)
    held = [{"a": anything(rng), "b": [anything(rng)]} for _ in range(60)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(held)] + [(100, None), (101, "3"), (102, "[]"), (103, "{}"), (None, '{"a":{"b":[[1],[]]}}')]
    got = documents.walk(spark.createDataFrame(rows, "doc long, j string"), ["doc"], "j").collect()

    def shown(v):
        return None if v is None else json.dumps(v) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v)

    want = sorted((str(i), p, q, shown(v) or "") for i, t in rows if t is not None for p, q, v in plain_walk(json.loads(t)))
    assert sorted((str(r.doc), r.path, r.pattern, r.value or "") for r in got) == want
    again = documents.walk(spark.createDataFrame(rows, "doc long, j string"), ["doc"], "j")
    assert documents.differences(again, again, ["doc"]).count() == 0
    assert documents.walk(spark.createDataFrame([], "doc long, j string"), ["doc"], "j").count() == 0


def test_changes_and_bindings(spark):
    one = spark.createDataFrame([(1, '{"a":1,"b":[1,2],"c":null}'), (2, '{"x":{"design":"v2"}}'), (3, '{"a":1}')], "doc long, j string")
    two = spark.createDataFrame([(1, '{"a":"1","b":[1],"c":null,"d":{}}'), (2, '{"x":{"y":[{"design":"v3"}]}}'), (4, '{"a":1}')], "doc long, j string")
    a, b = (documents.walk(x, ["doc"], "j") for x in (one, two))
    got = sorted((r.doc, r.path, r.status) for r in documents.differences(a, b, ["doc"]).collect())
    assert got == [(1, "a", "changed"), (1, "b[1]", "removed"), (1, "d", "added"), (2, "x.design", "removed"), (2, "x.y[0].design", "added"), (3, "a", "removed"), (4, "a", "added")]
    counts = {(r.pattern, r.status): (r.n_changes, r.n_documents) for r in documents.change_counts(documents.differences(a, b, ["doc"])).collect()}
    assert counts["x.y[*].design", "added"] == (1, 1) and counts["b[*]", "removed"] == (1, 1)
    faults = {r.doc: (r.n_bindings, r.n_wrong) for r in documents.binding_faults(b, ["doc"], "design", "v2").collect()}
    assert faults == {1: (0, 0), 2: (1, 1), 4: (0, 0)}


@pytest.mark.parametrize("change,message", [(None, None), ((2, 5.0), "x drifted: 2"), ((2, None), "x drifted: 2"), ("gone", "not stored: 3"), ("more", "not computed: 9")])
def test_a_drifted_row_stops_the_job(spark, change, message):
    rows = [(1, 1.0), (2, 2.0), (3, None), (None, float("nan"))]
    stored = [(k, change[1] if isinstance(change, tuple) and k == change[0] else v) for k, v in rows]
    stored = [r for r in stored if r[0] != 3] if change == "gone" else stored + [(9, 1.0)] * (change == "more")
    a, b = (spark.createDataFrame(x, "k int, x double") for x in (rows, stored))
    out = drift.gated(a, b, ["k"], ["x"], 1e-9)
    if message:
        with pytest.raises(Exception, match=message):
            out.collect()
    else:
        assert sorted(map(str, out.collect())) == sorted(map(str, a.collect()))
        assert drift.gated(a.withColumn("x", F.col("x") + 1e-12), b, ["k"], ["x"], 1e-9).count() == 4


def test_weights_go_by_name_and_digest():
    document = frozen.freeze({"a": 1.0, "b": 0.0, "c": 2.5})
    assert frozen.aligned(document, ["c", "a"], ["b"]) == [2.5, 1.0]
    for catalogue, out in ((["a", "b"], ()), (["a", "b", "c", "d"], ()), (["a", "a", "b", "c"], ())):
        with pytest.raises(ValueError, match="catalogues"):
            frozen.aligned(document, catalogue, out)
    with pytest.raises(ValueError, match="frozen"):
        frozen.aligned({**document, "weights": {**document["weights"], "a": 1.1}}, ["a", "b", "c"])
    with pytest.raises(ValueError, match="zero"):
        frozen.freeze({"a": 0.0})


def test_clustered_tables_are_pruned(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, 50, *range(100)]) if i % 3 else 50, f"text {i} " * 20) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, t string")
    laid = layout.clustered(df, "k", str(tmp_path / "laid"), files=8, row_group=16 << 10)
    assert sorted(map(str, laid.collect())) == sorted(map(str, df.collect()))
    spans = layout.files_of_range(laid, "k").collect()
    assert len(spans) == 8 and max(r.n for r in spans) < 3000  # the common value is in several files
    narrow = laid.where("k between 20 and 22")
    plan = narrow._jdf.queryExecution().executedPlan()
    assert narrow.count() == sum(k in (20, 21, 22) for k, _ in rows)
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k,20), LessThanOrEqual(k,22)]" in plan.toString()
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(p).metadata.row_group(i).column(0).statistics for p in (tmp_path / "laid").glob("*.parquet") for i in range(pq.ParquetFile(p).metadata.num_row_groups)]
    touched = [s for s in groups if s is not None and s.has_min_max and s.min <= 22 and s.max >= 20]
    assert len(groups) > 8 and len(touched) < len(groups) / 3


def test_walk_writes_documents_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(documents, "written", lambda df, made=documents.written: tables.append(1) or made(df))
    texts = ['{"a":{"b":{"c":[[1,{"d":"]["}]]}}}', '[1,[2,["\\\\"]],{"x<y":{"z":null}}]', '[{"a":1},{"a":[]}]', '"[[[[["', "7"]
    got = documents.walk(spark.createDataFrame(list(enumerate(texts)), "doc long, j string"), ["doc"], "j").collect()
    assert tables == [1]  # and not a table a level
    want = sorted((i, p, q) for i, t in enumerate(texts) for p, q, _ in plain_walk(json.loads(t)))
    assert sorted((r.doc, r.path, r.pattern) for r in got) == want
