"""Fill-in-middle, vector codes and repeated passages against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import codes, infill, suffix
from spanmill.llm import queries as llm_queries

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_like_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é𝄞 \t\n\r\x0b\x0c\x1c\xa0<PSM>") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "\n\t", "one", "one ", " one", "<P>", "a<", "S>b", "<P", "long words " * 40_000 + " ", "é" * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("form", F.lit("x"))
    made = infill.fill_in_middle(docs)
    got = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == Counter((i, *plain_infill(i, t), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.where("false")).collect() == []


@pytest.mark.parametrize("every,block,step", [(1, 3, 2), (2, 5, 1), (7, 64, 8), (256, 1 << 20, 4096)])
def test_checkpoints_find_every_cut(every, block, step):
    rng = random.Random(every)
    for _ in range(60):
        text = "".join(rng.choice("ab é𝄞 \n") for _ in range(rng.randint(0, 80)))
        units, data = UNITS.findall(text), np.frombuffer(text.encode(), np.uint8)
        index = infill.index_units(data, every, block)
        assert index.n_units == len(units) and len(index.at_bytes) == 1 + len(units) // every
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert infill.locate(data, index, u, step) == (len(head.encode()), len(head))


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (vec_id, vector, label) -> (vec_id, code, error, label_error) and the codebooks' digest, by full search in whole numbers."""
    usable = [(i, v, name) for i, v, name in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], name) for i, v, name in usable), key=lambda r: r[:2])
    whole = [r[:2] for r in named]
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in whole[:entries]] for p in range(parts)]

    def pick(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in whole:
                groups.setdefault(pick(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [(i, [pick(cut(v, p), books[p]) for p in range(parts)], name) for i, v, name in named]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = Counter()
    for _, picked, name in found:
        total[name] += sum(d for d, _ in picked)
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[name]) for i, f, name in found), digest


def test_codes_like_a_full_search(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 16)).round(1).tolist()
    vectors[7] = vectors[3]
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, None), (204, [1.0] * 15, 2), (205, [1.0] * 8, 2), (206, [], 2), (9, [0.0] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("v", F.lit(1))
    want, digest = plain_codes([r for r in rows if r[1] and len(r[1]) == 16])
    got = codes.compress(table).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(i, [float(i)] * 8, None) for i in (5, 3)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in codes.compress(few).collect()} == {(3, "00" * 8, 0, 0), (5, "01" * 8, 0, 0)}
    assert codes.compress(few.where("false")).collect() == []
    with pytest.raises(ValueError, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e6] * 8, 1)], "vec_id long, embedding array<float>, label int"))


def test_pruning_leaves_distances_out():
    rng = np.random.default_rng(1)
    book = rng.integers(-9000, 9000, (64, 8)) * rng.integers(1, 20, (64, 1))
    parts = rng.integers(-9000, 9000, (2000, 8)) * rng.integers(1, 20, (2000, 1))
    index, best, done = codes.nearest(parts, codes.ring(book))
    full = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (best == full.min(1)).all() and done < 0.8 * full.size


def plain_repeats(texts, length):
    """Bytes of texts that no repeated window covers, by a table of all windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        out.append((len(d), int(gone.sum()), len(edges) // 2, bytes(np.frombuffer(d, np.uint8)[~gone]), edges))
    return out


def _texts(rng, n, alphabet, longest, passages):
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(t))
            lo = rng.randint(0, len(p) // 2)
            t = t[:at] + p[lo : rng.randint(lo, len(p))] + t[at:]
        texts.append(t)
    return texts


@pytest.mark.parametrize("length,alphabet,shard,group", [(16, "ab", 1 << 19, 1 << 21), (40, "abé ", 900, 1 << 21), (40, "ab", 500, 3000), (200, "abcdefgh 𝄞é", 4000, 1 << 21), (60, "abcdefgh ", 1 << 19, 0)])
def test_repeats_like_a_table_of_all_windows(spark, length, alphabet, shard, group):
    rng = random.Random(length + shard)
    passages = ["".join(rng.choice(alphabet) for _ in range(3 * length)) for _ in range(4)]
    texts = _texts(rng, 60, alphabet, 4 * length, passages)
    texts += [None, "", "a" * length, "a" * (length + 5), "x" * (9 * length), "ab" * (3 * length), texts[0], texts[0], passages[0], "y" * (length - 1)] + [passages[1] * 2]
    texts += [f"{i} " + passages[2][: length - 2] + f" {i * 7919}" * length for i in range(30)]
    rows = list(enumerate(texts)) + [(None, passages[3]), (5, "z" + passages[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("t", F.lit("t"))
    got = suffix.remove_repeats(docs, length=length, shard_bytes=shard, group_bytes=group).collect()
    want = Counter((i, n, g, s, k, tuple(e)) for (i, _), (n, g, s, k, e) in zip(rows, plain_repeats([t for _, t in rows], length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), tuple(r.bounds)) for r in got) == want
    assert suffix.remove_repeats(docs.where("false")).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(2)
    for alphabet in (1, 2, 3, 256):
        for _ in range(60):
            text = bytes(rng.randrange(alphabet) for _ in range(rng.randint(0, 200)))
            data = np.frombuffer(text, np.uint8)
            order = sorted(range(len(text)), key=lambda i: text[i:])
            sa, rank = suffix.suffix_array(data)
            assert sa.tolist() == order and rank[sa].tolist() == list(range(len(text)))
            shared = [0] * len(text)
            for k in range(1, len(text)):
                a, b = text[order[k - 1] :], text[order[k] :]
                shared[k] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert suffix.common_prefixes(data, sa).tolist() == shared


def test_runs_are_cut_and_equal_windows_share_a_key():
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(500)) + "a" * 700
    text += text[100:400]
    data, length = np.frombuffer(text.encode(), np.uint8), 30
    keys, begins, sizes, more = suffix.runs(data, length, 8, 50)
    assert begins[0] == 0 and (begins[1:] == (begins + sizes)[:-1]).all() and sizes.sum() == len(text) - length + 1 and sizes.max() <= 50
    assert more.any() and not more.all()
    key_of = np.repeat(keys, sizes)
    seen = {}
    for i, k in enumerate(key_of.tolist()):
        assert seen.setdefault(text[i : i + length], k) == k


def test_registered_queries_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in llm_queries.QUERIES["op13_suffix_arrays"](spark, folder).collect()}
    assert len(got) == len(docs)
    for d, (n, gone, spans, kept, _) in zip(docs, plain_repeats([d.text for d in docs], 200)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    made = {r.doc_id: r for r in llm_queries.QUERIES["op11_infill_checkpoints"](spark, folder).collect()}
    for d in docs:
        n, form, a, b, out = plain_infill(d.doc_id, d.text)
        r = made[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
