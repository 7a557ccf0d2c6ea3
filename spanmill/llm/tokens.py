"""Whole-text tokenising through tables of distinct chunks.

A text is cut where no token can cross, each distinct chunk is segmented once
by the tokenizer library, and ids are joined back by position.  Tables live as
long as a task, hold a bounded number of bytes and start over when full; what
is too large for a table is segmented and not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Bytes that a task's table holds, about, before it starts over; and those of an entry besides its characters and ids.
TABLE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Characters of text whose chunks are looked up together.
GROUP_CHARS = 1 << 20

_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
#: White space by the bytes of its UTF-8 form, as numbers.
_SPACE_BYTES = {n: [int.from_bytes(c.encode()) for c in _SPACES if len(c.encode()) == n] for n in (1, 2, 3)}


class ChunkTable(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, segment: Callable[[list[str]], list[bytes]], limit: int = TABLE_BYTES) -> None:
        super().__init__()
        self.segment, self.limit, self.held = segment, limit, 0

    @staticmethod
    def bytes_of(chunks: list[str]) -> int:
        """About what entries take: a character gives an id at most, bar few."""
        return ENTRY_BYTES * len(chunks) + 5 * sum(map(len, chunks))

    def of(self, wanted: Collection[str]) -> dict[str, bytes]:
        """A table that has all ``wanted`` chunks, which are distinct, until the next call."""
        new = [c for c in wanted if c not in self]
        if not new:
            return self
        size = self.bytes_of(new)
        if self.held + size > self.limit:
            self.clear()
            new, self.held = list(wanted), 0
            size = self.bytes_of(new)
        made = zip(new, self.segment(new))
        if size > self.limit:
            return dict(made)
        self.update(made)
        self.held += size
        return self

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as chunks."""
        known = self.of(set().union(*texts)).__getitem__
        return [b"".join(map(known, chunks)) for chunks in texts]


def grouped(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters together."""
    rest = iter(texts)
    while run := list(islice(rest, 1)):
        size = len(run[0])
        while size < chars and (more := list(islice(rest, 1))):
            run += more
            size += len(more[0])
        yield run


def cut_at_spaces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after another, and where those of each text begin (and the last ones end).  Cuts are
    before the spaces that follow a character that is not white space, so runs of white space are never cut
    inside; an empty text has no piece."""
    column = pa.array(texts, pa.string())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, "<i4", len(texts) + 1)
    if not starts[-1]:
        return column[:0], np.zeros(len(texts) + 1, np.int64)
    units = np.frombuffer(data, np.uint8, starts[-1])
    spaces = np.flatnonzero(units == ord(" "))
    # the bytes before a space; where a text begins it is cut anyway
    before, inside = np.zeros(len(spaces), np.uint32), np.zeros(len(spaces), bool)
    for n, known in _SPACE_BYTES.items():
        before |= units[np.maximum(spaces - n, 0)].astype(np.uint32) << 8 * (n - 1)
        inside |= np.isin(before, known)
    begins = np.zeros(len(units), bool)
    begins[spaces[~inside]] = True
    begins[starts[:-1][starts[:-1] < starts[1:]]] = True
    at = np.flatnonzero(begins)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(units)).astype("<i4")), data)
    return pieces, np.searchsorted(at, starts)
