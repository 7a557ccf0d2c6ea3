"""Tokenising and packing against the libraries, whole text by whole text."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from spanmill.llm import packing, spm, tokens
from spanmill.llm.queries import tokenizer_file

TEXTS = st.text(alphabet="ab Zé ▁\n\t\r  　'st.,!?0𝄞\x00\x1c\x85", max_size=40)


@pytest.fixture(scope="module")
def pieces():
    return spm.PieceCoder(tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_coder():
    return packing.ByteCoder(tokenizer_file("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_pieces_like_the_library(pieces, text):
    assert pieces.plain
    ids = np.frombuffer(pieces.encode([text])[0], "<u4").tolist()
    assert ids == pieces.model.encode(text)
    assert pieces.decode(ids) == pieces.model.decode(ids)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_bytes_like_the_library(byte_coder, text):
    assert np.frombuffer(byte_coder.encode([text])[0], "<u4").tolist() == byte_coder.model.encode(text, add_special_tokens=False).ids


WORDY = st.lists(st.sampled_from(["Den", "über", "St", "x²", "٣", "ａ", "\n", "\n\n", " ", "  ", ".", "***", "'s", "'", "_", "#&", "\r\n", "７"]), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(text=WORDY)
def test_words_marks_and_lines_like_the_library(byte_coder, text):
    assert np.frombuffer(byte_coder.encode([text])[0], "<u4").tolist() == byte_coder.model.encode(text, add_special_tokens=False).ids


def test_words_known_as_pieces_are_not_segmented_again(monkeypatch):
    """A word is segmented once, alone or with marks, and ids stay those of the library while tables start over."""
    import gc

    asked = []
    monkeypatch.setattr(packing.ByteCoder, "_words", lambda self, words, f=packing.ByteCoder._words: asked.extend(words) or f(self, words))
    monkeypatch.setattr(packing.ByteCoder, "_whole", lambda self, texts, f=packing.ByteCoder._whole: f(self, texts) if not asked.append(gc.isenabled()) else None)
    coder = packing.ByteCoder(tokenizer_file("byte_bpe_50k.json"))
    asked.clear()
    coder.encode(["x Wort Wort, Wort.\nWort", "x Wort; Wort.\nWort! über, über"])
    coder.encode(["x Wort: über. Mond,", "x Mond!"])
    assert sorted(w for w in asked if isinstance(w, str)) == sorted([" Wort", "Wort", " über", " Mond"]) and not any(w is True for w in asked) and gc.isenabled()
    rng = random.Random(3)
    words = ["Wort", "über", "Mond", "a", "Zé", "٣x", "it's", "(q)", "f\ng", "f,\ng.", "f\n\ng", "x²!", "_", "a_b", "ａ."]
    small = packing.ByteCoder(tokenizer_file("byte_bpe_50k.json"), limit=3 * tokens.ENTRY_BYTES)
    for _ in range(60):
        texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n" + rng.choice(words)]) for _ in range(rng.randrange(12))) for _ in range(3)]
        assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(texts)] == [small.model.encode(t, add_special_tokens=False).ids for t in texts]


SPACED = st.lists(st.sampled_from(["a", "é", "字", "😀", " ", "  ", "\n", "\x1f", "\x85", "\xa0", "\u1680", "\u2009", "\u2028", "\u205f", "\u3000", "\u200b", "Å"]), max_size=9).map("".join)


@settings(max_examples=600, deadline=None)
@given(texts=st.lists(SPACED, max_size=5))
def test_texts_are_cut_together_like_each_alone(texts):
    import re

    pieces, at = tokens.cut_at_spaces(texts)
    pieces = pieces.to_pylist()
    assert at.tolist()[-1] == len(pieces)
    for text, a, b in zip(texts, at.tolist(), at.tolist()[1:]):
        first, *others = re.split(r"(?<=\S) ", text)
        assert pieces[a:b] == ([first, *(" " + p for p in others)] if text else [])


def test_a_full_table_starts_over():
    seen = []
    limit = 3 * tokens.ENTRY_BYTES + 20
    table = tokens.ChunkTable(lambda cs: [seen.append(c) or c.encode() for c in cs], limit)
    assert table.ids([["a", "b"], ["c"]]) == [b"ab", b"c"]
    assert table.ids([["d", "a"]]) == [b"da"] and len(table) <= 3
    assert seen.count("a") == 2
    huge = "x" * limit  # more than the table may hold: segmented, not kept
    assert table.ids([["a", huge, "a"], [huge]]) == [b"a" + huge.encode() + b"a", huge.encode()] and huge not in table and table.held <= limit
    assert table.ids([["a"]]) == [b"a"]


def test_settings_of_the_normaliser_are_read():
    field = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    keeps = bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    assert spm.keeps_text(field(3, keeps)) and spm.keeps_text(field(2, bytes([4 << 3, 9])) + field(3, keeps))
    assert not spm.keeps_text(field(3, bytes([3 << 3, 1])))  # drops spaces unless told otherwise
    assert not spm.keeps_text(field(3, field(2, b"map") + keeps))
    assert not spm.keeps_text(field(3, keeps) + field(2, bytes([24 << 3 & 127 | 128, 1, 1])))
    assert not spm.keeps_text(field(3, bytes([3 << 3, 0, 4 << 3, 0])))


def test_documents_encoded_with_edges(spark, pieces):
    rows = [(1, "Hello  wörld\nagain"), (1, "Hello  wörld\nagain"), (2, None), (3, ""), (None, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = spm.encode_documents(df, tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == 5
    for r in got:
        text = next((t or "") for k, t in rows if k == r.doc_id)
        ids = [1, *pieces.model.encode(text), 2]
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids) and r.decoded == pieces.model.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert spm.encode_documents(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def best_fill(lengths, capacity):
    items = [k for k, n in lengths.items() for _ in range(n)]
    return max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= capacity)


@pytest.mark.parametrize("seed", range(40))
def test_fill_is_the_closest_multiset(seed):
    rng = random.Random(seed)
    lengths = {rng.randint(1, 60): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
    capacity = rng.randint(5, 120)
    got = packing.fill(lengths, capacity)
    assert all(n <= lengths[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == best_fill(lengths, capacity)


def packed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    return packing.pack_documents(df, tokenizer_file("byte_bpe_50k.json"), **options).collect()


def test_packing_covers_every_id_once(spark, byte_coder):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma", "δ"]) for _ in range(rng.randint(0, 900))) or None, 7) for i in range(150)]
    got = packed(spark, rows, window=256, pool=40)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text, _ in rows:
        ids = np.array([*byte_coder.model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        short += at < 256 - packing.SLACK and at & (at - 1) > 0
    assert short == 0  # the last of a partition are powers of two, which take no padding


def test_what_is_left_goes_into_powers_of_two():
    pieces = [(1, 5, bytes(4 * 300), 305), (2, 0, bytes(4 * 399), 399), (3, 0, bytes(4), 1)]
    made = list(packing.in_powers_of_two(pieces))
    assert [sum(len(p[2]) // 4 for p in s) for s in made] == [512, 128, 32, 16, 8, 4]
    flat = [(p[0], p[1] + k) for s in made for p in s for k in range(len(p[2]) // 4)]
    assert flat == [(d, start + k) for d, start, ids, _ in pieces for k in range(len(ids) // 4)]


def test_packing_edges(spark):
    got = packed(spark, [(None, None, 1), (1, "", 1), (1, "", 1)])
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 1), (False, 1), (True, 1)]
    assert packed(spark, [(1, "a", 1)])[0].length == 2
