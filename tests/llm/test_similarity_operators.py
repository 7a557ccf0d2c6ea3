"""Near-duplicates, nearest neighbours, toxicity, fixity and the pipeline against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import fixity, imi, minhash, toxicity, wordhash

# ---- near-duplicates ------------------------------------------------------------


def plain_sets(texts, width):
    out = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def plain_components(texts, width, percent):
    sets = plain_sets(texts, width)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def corpus(seed, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for k in range(n):
        if texts and rng.random() < 0.6:
            w = (rng.choice(texts)[1] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
            texts.append((k, t.upper() if rng.random() < 0.2 else t))
        else:
            texts.append((k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 30, 60, 120])))))
    return [*texts, (n, None), (n + 1, ""), (n + 2, " \t\n")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components_like_all_pairs(spark, seed, width, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # so that buckets fall into several blocks
    texts = corpus(seed)
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("rep", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, percent).collect()}
    assert got == plain_components(texts, width, percent)


def test_near_duplicate_edges(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A b C d"), (7, None)]
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (7, 7, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_several_texts_of_one_id_are_one_document(spark):
    """Plain version: rows of an id are linked, and rows whose sets are alike."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "x y z u v w")
    rows = [(3, a), (9, a), (9, b), (11, b), (11, ""), (20, c), (20, "q r s t"), (21, "q r s t"), (22, None), (22, "lone words here now")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect())
    want = {3: 3, 9: 3, 11: 3, 20: 20, 21: 20, 22: 22}
    assert got == sorted((k, want[k], want[k] == k) for k, _ in rows)
    twins = [(5, a), (5, b), (6, a), (7, b), (8, b + " more")]  # one id stands for two classes
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(twins, "doc_id long, text string"), 3, 80).collect()}
    assert got == dict.fromkeys((5, 6, 7, 8), 5)


def test_no_pair_near_the_threshold_is_lost(spark):
    """Recall by pairs whose likeness is 0.85 to 0.87; the whole table is scanned once."""
    rng, rows = random.Random(5), []
    for k in range(0, 600, 2):
        w = [f"w{rng.randrange(10**6)}" for _ in range(122)]
        rows += [(k, " ".join(w)), (k + 1, " ".join([*w[:111], *(f"v{rng.randrange(10**6)}" for _ in range(11))]) if k % 4 else " ".join(w[:112]))]
    truth = plain_components(rows, 3, 85)
    linked = [k for k in range(0, 600, 2) if truth[k + 1][1] == k]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert len(linked) > 100 and {k: v for k, (_, v) in truth.items()} == got


@pytest.mark.parametrize("dense", [0, 3, 10**9])
def test_sizes_of_intersections(dense):
    rng = random.Random(dense)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(0, 30))), np.int64) for _ in range(25)]
    got = minhash.common_sizes(sets[:9], sets[9:], dense, 7)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[9:]] for a in sets[:9]]


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    s = minhash.signatures(np.concatenate([a, b]), np.array([1000, 1000]), 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.07
    assert minhash.bands_for(85) == 20 and minhash.bands_for(80) > 20


def test_word_hashes_are_of_words_alone():
    import pyarrow as pa

    column = pa.array(["One two three", None, "", "x one  two\x0bthree y", "ONE TWO THREE"])
    (first, hashes, lengths), = wordhash.shingle_sets(column, 3)
    assert first == 0 and lengths.tolist() == [1, 0, 0, 3, 1]
    assert hashes[0] == hashes[-1] and hashes[0] in hashes[1:4]


def test_words_of_like_algebra_are_told_apart(spark):
    import pyarrow as pa

    def balanced(n, one, other):
        word, swap = one, str.maketrans(one + other, other + one)
        while len(word) < n:
            word += word.translate(swap)
        return word, word.translate(swap)

    pairs = [balanced(n, *letters) for n in (16, 64, 128, 1024, 4096) for letters in ("ab", "xz")]
    column = pa.array([w for pair in pairs for w in pair] + ["a", "a\x00", "\x00a", "a" * 64, "a" * 65, "b" * 8, "b" * 9])
    seen = [int(h) for _, hashes, _ in wordhash.shingle_sets(column, 3) for h in hashes]
    assert len(seen) == len(set(seen)) == len(column)
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(balanced(2048, "a", "b"))], "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(docs, width=3, percent=85).collect())


# ---- nearest neighbours -----------------------------------------------------------


def test_search_recall_scores_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[5] = x[7] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = imi.search(df, k=10, every=20).collect()
    d = x.astype(float)
    hits = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
        assert abs(r.score - d[r.query_id] @ d[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    assert sorted(by_query) == list(range(0, 1500, 20))
    for q, rows in by_query.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        s = d @ d[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in rows} & set(np.argsort(-s, kind="stable")[:10]))
    assert hits >= 0.9 * 10 * len(by_query)
    found = [r.vec_id for r in by_query[40][:2]]
    assert found == [5, 7]


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], None)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in imi.search(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1, 9), (0, 2, 20), (20, 1, 9), (20, 2, 0)]
    assert imi.search(spark.createDataFrame([], schema)).count() == 0
    twice = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    assert [(r.rank, r.vec_id) for r in imi.search(spark.createDataFrame(twice, schema)).orderBy("rank").collect()] == [(1, 1), (2, 2)]


# ---- toxicity -----------------------------------------------------------------------


def test_chain_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    chain = toxicity.fit_chain(docs, train)
    scored = toxicity.score_documents(docs, chain).join(test, "doc_id").select("toxic", (F.col("p_toxic") >= 0.5).cast("int").alias("said")).collect()
    toxic, clean = [r.said for r in scored if r.toxic], [r.said for r in scored if not r.toxic]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.02 * len(clean)  # from 18 toxic rows


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 3)).astype(np.float32)
    first = x[:, 0]
    labels = np.stack([first, first * x[:, 1]], axis=1)
    fold = np.arange(len(x)) % 3
    models = toxicity.fit_models(x, labels, fold)
    assert [len(m.weights) for m in models] == [3, 4]
    p = toxicity.ToxicityChain(("a", "b"), {}, models).predict(x)
    assert ((p[:, 0] > 0.5) == labels[:, 0]).all() and ((p[:, 1] > 0.5) == labels[:, 1]).mean() > 0.99


def test_terms_of_a_fold_are_chosen_without_it(spark):
    """A word that tells one fold's rows alone is no term of the model that predicts them."""
    ids = list(range(300))
    fold = {r.i: r.f for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    rows = [(i, f"common words {'leak' if fold[i] == 0 and i % 2 else 'other'} here") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).cast("int")).withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    counts = texts.mapInPandas(toxicity._count_terms(("toxic",)), "term string, fold int, toxic int, n long")
    totals = {("toxic", v, f): sum(1 for i in ids if i % 2 == v and fold[i] == f) for v in (0, 1) for f in range(toxicity.FOLDS)}
    assert "=leak" in toxicity._telling(counts, totals, ("toxic",), None, 50)
    assert "=leak" not in toxicity._telling(counts, totals, ("toxic",), 0, 50)


def test_scores_like_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit_chain(docs, labels)
    clash = docs.select("doc_id", "text", F.lit("mine").alias("chain"), F.lit("old").alias("p_toxic"), F.lit("x").alias("_chain"))
    got = toxicity.score_documents(clash, chain)
    assert got.columns == ["doc_id", "text", "chain", "_chain", "p_quality", "p_toxic"]
    assert got.where("chain <> 'mine' or _chain <> 'x'").count() == 0
    for r in got.collect():
        x = [chain.scales[i] if t in toxicity.document_terms(r.text) else 0.0 for t, i in chain.terms.items()]
        for model, said in zip(chain.models, (r.p_quality, r.p_toxic)):
            p = 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(x, model.weights)) + model.bias, -30, 30)))
            assert abs(p - said) < 1e-6
            x.append(p)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, None), (3, "", "y"), (1, "you idiot", "x"), (None, "fine words", "z")], "doc_id long, text string, p_other string")
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit_chain(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.p_toxic <= 1 for r in got) and "p_other" in docs.columns
    none = toxicity.fit_chain(docs, labels.limit(0))
    assert all(r.p_toxic < 0.5 for r in toxicity.score_documents(docs, none).collect())
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


# ---- fixity ---------------------------------------------------------------------------


def pages(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.lit("html "), (F.col("id") % 7).cast("int")).alias("html"))


def test_audit_finds_exactly_the_damage(spark):
    whole = pages(spark, 700)
    hurt = whole.withColumn("html", F.when(F.col("page_id").isin(0, 511, 512, 699), "!").otherwise(F.col("html")))
    left, right = fixity.leaves(whole), fixity.leaves(hurt)
    assert sorted((r.page_id, r.damage) for r in fixity.audit(left, right).collect()) == [(0, "altered"), (511, "altered"), (512, "altered"), (699, "altered")]
    assert fixity.audit(left, left).count() == 0
    short = fixity.leaves(whole.where("page_id < 699"))
    assert [(r.page_id, r.damage) for r in fixity.audit(left, short).collect()] == [(699, "missing")]
    assert [(r.page_id, r.damage) for r in fixity.audit(short, left).collect()] == [(699, "surplus")]


@pytest.mark.parametrize("place", [0, 50, 99])
def test_a_record_gone_added_or_shortened_is_named_alone(spark, place):
    whole = pages(spark, 100)
    left = fixity.leaves(whole)
    report = lambda a, b: [(r.page_id, r.damage) for r in fixity.audit(a, b).collect()]
    gone = fixity.leaves(whole.where(f"page_id <> {place}"))
    assert report(left, gone) == [(place, "missing")] and report(gone, left) == [(place, "surplus")]
    assert report(left, fixity.leaves(whole.withColumn("html", F.when(F.col("page_id") == place, "").otherwise(F.concat("html", F.lit("x")))))) != []
    longer = fixity.leaves(whole.withColumn("html", F.when(F.col("page_id") == place, "much longer than it was").otherwise(F.col("html"))))
    assert report(left, longer) == [(place, "altered")]
    twice = fixity.leaves(whole.union(whole.where(f"page_id = {place}")))
    assert report(left, twice) == [(place, "surplus")] and report(twice, left) == [(place, "missing")]


def test_a_changed_size_changes_the_nodes_above_it_alone(spark):
    whole = pages(spark, 512)
    trees = [fixity.merkle_tree(fixity.leaves(x)) for x in (whole, whole.withColumn("html", F.when(F.col("page_id") == 100, "!!").otherwise(F.col("html"))))]
    for a, b in zip(*trees):
        changed = a.alias("a").join(b.alias("b"), ["warc", "place"]).where("a.digest <> b.digest").count()
        assert changed == 1


def test_tree_levels_and_edges(spark):
    tree = fixity.merkle_tree(fixity.leaves(pages(spark, 600)))
    assert [t.where("warc = 0").count() for t in tree] == [512, 32, 2, 1]
    assert tree[-1].count() == 2
    odd = spark.createDataFrame([(None, None, None), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string").withColumn("place", F.lit(3))
    rows = fixity.leaves(odd).collect()
    assert len(rows) == 3 and all(r.stop > r.start for r in rows)
    assert fixity.audit(fixity.leaves(odd.limit(0)), fixity.leaves(odd.limit(0))).count() == 0
    assert {r.damage for r in fixity.audit(fixity.leaves(odd), fixity.leaves(odd.limit(0))).collect()} == {"missing"}


# ---- queries and the pipeline ------------------------------------------------------------


def test_queries_with_sql(spark, duck):
    from conftest import same_rows

    from spanmill.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        same_rows(QUERIES[name](spark, "/root/testdata/sf0.001"), duck, sql)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    kept = cp.drop_toxic(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.where("toxic = 0")
    assert kept.join(clean, "doc_id").count() == docs.join(clean, "doc_id").count()
    assert kept.join(labels.where("toxic = 1"), "doc_id").count() <= 5  # of 51; a few have no telling word
    single = cp.drop_near_duplicates(spark, kept, sf)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    groups = plain_components(texts, cp.WIDTH, cp.PERCENT)
    assert {r.doc_id for r in single.collect()} == {k for k, (_, c) in groups.items() if c == k}
    hidden = cp.hide_private(spark, single, sf)
    assert hidden.columns == docs.columns and hidden.where("n_chars <> length(text)").count() == 0
    packed = cp.pack(spark, hidden, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in hidden.select("doc_id").collect()}


def test_places_of_an_id_with_many_records(spark):
    import hashlib

    rows = [(7, "u", f"text {i % 40}" * (i % 3)) for i in range(700)] + [(i, "u", None) for i in range(5, 10)] + [(None, "u", f"{i % 3}") for i in range(20)]
    got = sorted(((r.warc, r.place, r.page_id, r.start, r.stop, r.digest) for r in fixity.leaves(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=lambda r: r[:2])
    files = {}
    for page, url, html in rows:
        body = (html or "").encode()
        record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        files.setdefault(page is None, []).append((-1 if page is None else page, hashlib.sha256(record).hexdigest(), len(record)))
    for none, records in files.items():
        own = [r for r in got if (r[2] is None) == none]
        at = 0
        for k, ((page, digest, size), r) in enumerate(zip(sorted(records), own, strict=True)):
            assert r[1:] == (k, None if none else page, at, at + size, digest)
            at += size
