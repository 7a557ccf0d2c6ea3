"""Vectorised 64-bit hashes of words and word shingles, computed on Arrow buffers.

A word is hashed eight bytes at a time: every step mixes the state with a keyed
bijection after the bytes are added, so no algebra of letters makes words
collide; words of more than ``LONG`` bytes go through a keyed BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
KEY, LONG = 0x9E3779B97F4A7C15, 64
CHUNK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The bytes of a word that count in its last step, by their number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def hash_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keyed hashes of the words of ``data`` (lowered bytes) at ``start``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    state = mix64(length.astype(U) + U(KEY))
    row, at, left = np.flatnonzero(length <= LONG), start, length
    while len(row):
        take = np.minimum(left[row], 8)
        state[row] = mix64((state[row] ^ (eight[at[row]] & _MASK[take])) * U(0xD6E8FEB86659FD93) + U(KEY))
        at, left = at + 8, left - 8
        row = row[left[row] > 0]
    for k in np.flatnonzero(length > LONG).tolist():
        word = data[start[k] : start[k] + length[k]].tobytes()
        state[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY.to_bytes(8, "little")).digest(), "little")
    return state


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and each value's bounds; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word in the bytes of ``bounds``, in order."""
    lo, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    data = _LOWER[raw[lo : lo + n]]
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds - lo] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends)
    return hash_words(data, start, stop + 1 - start), np.searchsorted(bounds - lo, start, "right") - 1


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first document, hashes, lengths) for runs of about a quarter megabyte of text:
    the sorted distinct hashes of each document's shingles, one after another.
    Words are split at ASCII white space with A-Z lowered.  A text of fewer
    words than ``width`` has its whole sequence as one shingle, one without
    words has none."""
    raw, bounds = string_buffers(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
        words, doc = _word_hashes(raw, bounds[first : last + 1])
        count = np.bincount(doc, minlength=last - first) if len(doc) else np.zeros(last - first, np.int64)
        yield first, *_distinct(words, count, width)
        first = last


def _distinct(words: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    head = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(head[-1]) - np.repeat(head[:-1], size) + np.repeat(begin, size)
    short = np.repeat((count < width) & (count > 0), size)
    out = np.zeros(head[-1], U)
    padded = np.concatenate((words, np.zeros(width, U)))
    left = np.repeat(count, size)
    for k in range(width):
        part = padded[place + k]
        step = out * U(0xFF51AFD7ED558CCD) + part
        out = np.where(short & (k >= left), out, step) if short.any() else step
    out[short] += left[short].astype(U)
    out = mix64(out)
    for a, b in zip(head[:-1], head[1:]):
        out[a:b].sort()
    if not len(out):
        return out, size
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[head[:-1][size > 0]] = True
    owner = np.repeat(np.arange(len(size)), size)
    return out[keep], np.bincount(owner[keep], minlength=len(size))
