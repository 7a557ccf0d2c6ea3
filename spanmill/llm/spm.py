"""SentencePiece encoding and decoding by a table of distinct marked words.

The model marks a space as U+2581.  No piece has a marker after another
character (checked when the model is loaded), so a text falls into words that
begin with their markers; each distinct word is segmented once and its ids are
joined back by position.  Identical to encoding the whole text.  A model whose
normaliser changes texts (its settings are read) encodes them whole.

Null texts count as empty: only the begin and end ids.  Texts and words of any
length are encoded whole.  Rows are independent, so repeated rows, null ids and
extra columns need no care; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from spanmill.llm.common import bound_batches
from spanmill.llm.tokens import ChunkTable, grouped

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def wire_fields(message: bytes) -> dict[int, list]:
    """The fields of a protobuf message by number: integers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = message[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


def keeps_text(model: bytes) -> bool:
    """Whether a serialised model changes no character, puts one marker before the text, keeps
    every space and marks it in front: field 3 is the normaliser (2 its character map, 3
    the marker in front, 4 dropping spaces, 5 marking them), 24 of field 2 markers behind words."""
    fields = wire_fields(model)
    normaliser = wire_fields(b"".join(fields.get(3, [])))
    trainer = wire_fields(b"".join(fields.get(2, [])))
    said = lambda of, number, default: (of.get(number) or [default])[-1]
    return not said(normaliser, 2, b"") and bool(said(normaliser, 3, 1)) and not said(normaliser, 4, 1) and bool(said(normaliser, 5, 1)) and not said(trainer, 24, 0)


class PieceCoder:
    """Encodes and decodes whole texts exactly as the library does."""

    def __init__(self, model_file: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a white-space marker")
        self.lone = array("I", [self.model.piece_to_id(MARK)]).tobytes()
        self.table = ChunkTable(self._segment)
        self.plain = keeps_text(self.model.serialized_model_proto())

    def _whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text)).tobytes()

    def _segment(self, words: list[str]) -> list[bytes]:
        # a word is given without its first marker, since the library puts one before what it encodes
        out = [array("I", x).tobytes() for x in self.model.encode([w.replace(MARK, " ") for w in words], num_threads=1)]
        return [x if w else self.lone for w, x in zip(words, out)]

    def _words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        return self.table.ids([self._words(t) for t in texts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids in little-endian unsigned 32-bit integers, without begin and end."""
        return self._by_words(texts) if self.plain else [self._whole(t) for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, ids binary, n_tokens, ids_sha256, decoded_sha256[, decoded]): ids with the
    begin and end ids, as little-endian unsigned 32-bit integers; ``with_ids`` keeps
    the ids and the decoded text beside their digests."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_file)
        first = np.array([coder.model.bos_id()], "<u4").tobytes()
        last = np.array([coder.model.eos_id()], "<u4").tobytes()
        for batch in batches:
            count, digest, back, kept, texts = [], [], [], [], []
            values = [v or "" for v in batch.column(1).to_pylist()]
            for body in (x for run_of in grouped(values) for x in coder.encode(run_of)):
                ids = first + body + last
                decoded = coder.decode(np.frombuffer(ids, "<u4").tolist())
                count.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns += [pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)
