"""Sequence packing by minimum bin slack.

A document's ids are cut into full windows and a remainder.  A full window is a sequence by itself; remainders are
pooled by length, and each further sequence takes the multiset of pooled
lengths whose sum comes closest to the window: a bitset holds the sums that the
counted lengths reach, and backtracking over the stages gives the counts.  A
multiset without slack is used again while its lengths last.  Where even
the best multiset leaves more than ``SLACK`` tokens, the longest remainder
left is cut to fill them, so padding stays small whatever the lengths are.
What a task has left for its last sequence is cut into sequences of powers of
two, which take no padding.

Tasks pack their own rows, so nothing is shuffled and memory holds one pool of
remainders.  A sequence is named by partition and running number, which a
repeated task finds again.  Null texts count as empty (only the end id).  Rows
are independent: repeated rows and null ids are packed like others, extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanmill.llm.common import bound_batches
from spanmill.llm.tokens import TABLE_BYTES, ChunkTable, cut_at_spaces, grouped

WINDOW = 1024
#: Remainders pooled before sequences are closed.
POOL = 8192
#: Tokens of a sequence that may stay empty while remainders are left.
SLACK = 8
END_ID = 0
#: Characters of text whose pieces are looked up together.
RUN_CHARS = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the available ``lengths`` whose sum is as near ``capacity`` as can
    be without passing it.  Longer lengths are used before shorter ones."""
    stages: list[tuple[int, int, int]] = []
    reach, full, mask = 1, 1 << capacity, (2 << capacity) - 1
    for length in sorted(lengths, reverse=True):
        left = min(lengths[length], capacity // length)
        many = 1
        while left and not reach & full:
            take = min(many, left)  # binary splitting: any count up to the bound is a sum of the parts
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            many *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


class _Pool:
    """Remainders by length, as (doc_id, start, ids, doc_tokens); the oldest of a length is placed first."""

    def __init__(self, window: int) -> None:
        self.window, self.by_length, self.n = window, {}, 0

    def add(self, piece: tuple[int | None, int, bytes, int]) -> None:
        self.by_length.setdefault(len(piece[2]) // 4, []).append(piece)
        self.n += 1

    def take(self, length: int, count: int) -> list[tuple]:
        rows = self.by_length[length]
        out = rows[:count]
        del rows[:count]
        if not rows:
            del self.by_length[length]
        self.n -= count
        return out

    def _taken(self, counts: dict[int, int]) -> list[tuple]:
        return [piece for length in sorted(counts, reverse=True) for piece in self.take(length, counts[length])]

    def sequences(self, down_to: int) -> Iterator[list[tuple]]:
        while self.n > down_to:
            counts = fill({k: len(v) for k, v in self.by_length.items()}, self.window)
            slack = self.window - sum(k * n for k, n in counts.items())
            # what leaves no slack is the closest for further windows too, while its lengths last
            last = 1 if slack else min(len(self.by_length[k]) // n for k, n in counts.items())
            for _ in range(last - 1):
                yield self._taken(counts)
            out = self._taken(counts)
            if slack > SLACK and self.n:
                doc, start, ids, tokens = self.take(max(self.by_length), 1)[0]
                out.append((doc, start, ids[: 4 * slack], tokens))
                self.add((doc, start + slack, ids[4 * slack :], tokens))
            elif slack and not self.n:
                yield from in_powers_of_two(out)
                return
            yield out


def in_powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces' tokens in order, in sequences of the powers of two that sum to their number."""
    left = sum(len(p[2]) // 4 for p in pieces)
    rest = pieces[::-1]
    while left:
        size = 1 << left.bit_length() - 1
        left -= size
        out = []
        while size:
            doc, start, ids, tokens = rest.pop()
            here = min(size, len(ids) // 4)
            out.append((doc, start, ids[: 4 * here], tokens))
            if 4 * here < len(ids):
                rest.append((doc, start + here, ids[4 * here :], tokens))
            size -= here
        yield out


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteCoder:
    """Ids of whole texts by the tokenizers library, without special tokens added.

    The byte-level pre-tokenizer always cuts before a space that follows other
    text, so the pieces between such spaces are encoded apart, each distinct
    one once.  A piece of letters, perhaps with a run of ASCII marks after it, and
    perhaps with such a word on the next line, is cut by the pre-tokenizer just there;
    its parts go to the vocabulary's merges directly, or are known as pieces of
    their own.  Other pieces go through the whole tokenizer."""

    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

    def __init__(self, tokenizer_file: str, limit: int = TABLE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        self.merges, self.letters = self.model.model, _byte_letters()
        self.line = self._whole(["\n"])[0]
        self.heads, self.marks, self.words = (ChunkTable(f, limit) for f in (self._whole, self._whole, self._words))
        self.table = ChunkTable(self._pieces, 2 * limit)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, some with a space before them."""
        tokenize = self.merges.tokenize
        spelled = (w.replace(" ", "Ġ") if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words)
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in spelled]

    def _parts(self, piece: str) -> tuple[str, ...]:
        """(word, marks) or (word, marks, word, marks) of a piece, () where it is none of these."""
        word = piece.rstrip(self.MARKS)
        if word.isalpha():
            return word, piece[len(word) :]
        first, line, second = piece.partition("\n")
        word, other = first.rstrip(self.MARKS), second.rstrip(self.MARKS)
        return (word, first[len(word) :], other, second[len(other) :]) if line and word.isalpha() and other.isalpha() else ()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with a space before it."""
        alone = [p for p in pieces if p.isalpha()]
        made = dict(zip(alone, self._words([" " + p for p in alone])))
        parts = {p: self._parts(p) for p in pieces if p not in made}
        whole = [p for p, s in parts.items() if not s]
        first = {s[0] for s in parts.values() if s}
        spaced = {w: ids for w in first if (ids := made.get(w) or self.table.get(w))}
        words = self.words.of({" " + w for w in first if w not in spaced} | {s[2] for s in parts.values() if len(s) > 2})
        spaced.update([(w, words[" " + w]) for w in first if w not in spaced])
        marks = self.marks.of({m for s in parts.values() for m in s[1::2]})
        made.update(zip(whole, self._whole([" " + p for p in whole])))
        for p, s in parts.items():
            if len(s) == 2:
                made[p] = spaced[s[0]] + marks[s[1]]
            elif s:
                made[p] = spaced[s[0]] + marks[s[1]] + self.line + words[s[2]] + marks[s[3]]
        return [made[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts.  Only distinct pieces become Python strings; ids are joined by position in numpy.
        Collection of cycles rests meanwhile: it would walk the tables over and over, and what is made here has no
        cycles."""
        collects = gc.isenabled()
        gc.disable()
        try:
            pieces, at = cut_at_spaces(texts)
            coded = pieces.dictionary_encode()
            distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            heads = self.heads.of([p for p in distinct if p[0] != " "])
            bare = [p[1:] if p[0] == " " else None for p in distinct]
            spaced = self.table.of([p for p in bare if p is not None])
            return _joined([heads[p] if b is None else spaced[b] for p, b in zip(distinct, bare)], codes, at)
        finally:
            if collects:
                gc.enable()


def _joined(ids: list[bytes], codes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The ids of texts whose pieces are ``codes``, those of a text from ``at`` to the next."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    first, here = np.cumsum(size) - size, size[codes]
    end = np.concatenate([[0], np.cumsum(here)])
    source = np.repeat(first[codes] - end[:-1], here) + np.arange(end[-1])
    out = np.frombuffer(b"".join(ids), "<u4")[source]
    return [out[a:b].tobytes() for a, b in pairwise(end[at].tolist())]


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """``docs`` (doc_id, text) -> a row per piece, see ``SCHEMA``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = ByteCoder(tokenizer_file)
        rest = _Pool(window)
        number = TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[tuple] = []

        def place(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for doc, start, part, tokens in pieces:
                rows.append((doc, start, len(part) // 4, zlib.crc32(part), tokens, number, at))
                at += len(part) // 4
            number += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bodies = (x for some in grouped(texts, RUN_CHARS) for x in coder.encode(some))
            for doc, body in zip(batch.column(0).to_pylist(), bodies):
                ids = body + end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    piece = (doc, start, ids[4 * start : 4 * (start + window)], tokens)
                    if start + window <= tokens:
                        place([piece])
                    else:
                        rest.add(piece)
            if rest.n > pool:
                for pieces in rest.sequences(pool // 2):
                    place(pieces)
            yield flushed()
        for pieces in rest.sequences(0):
            place(pieces)
        yield flushed()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
