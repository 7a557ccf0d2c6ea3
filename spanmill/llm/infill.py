"""Fill-in-middle transformation with a sparse checkpoint index.

A text is a sequence of units (a word with the ASCII white space before it, or
white space at the end).  Counting them goes over the text's UTF-8 bytes in
blocks and records, every ``EVERY`` units, where a unit ends in bytes and in code
points.  A cut after u units takes the last checkpoint at or before it by
binary search and rescans the few bytes from there, so no list of all
units is ever held: a text costs itself, a block and its checkpoints.

Cuts and form come from the SHA-256 of ``seed:doc_id``, so a document is always
transformed alike.  Control strings stand between the parts; a text that
holds one of them itself, or is empty, stays plain, so that ``restored`` gives every
text back exactly.

Null texts are empty and plain; white space alone is one unit; a null id is
hashed as an empty string; rows sharing an id have the same digest and each
its own row.  Columns of the input besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bound_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints, and bytes of a counting block and of a rescan's step.
EVERY, BLOCK, STEP = 256, 1 << 20, 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Checkpoints(NamedTuple):
    """Where every ``every``-th unit ends; entry 0 is the start of the text."""

    n_units: int
    every: int
    at_bytes: np.ndarray
    at_points: np.ndarray


def _points(data: np.ndarray) -> int:
    """Code points that begin in these bytes."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def _ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ends of the units that end at start < end <= stop: behind a word's last byte, and at
    the end of the text if white space is last."""
    space = _SPACE[data[start : min(stop + 1, len(data))]]
    word = ~space[: stop - start]
    following = np.ones(stop - start, bool)
    following[: len(space) - 1] = space[1:]
    ends = np.flatnonzero(word & following) + start + 1
    if stop == len(data) and stop > start and space[stop - start - 1]:
        ends = np.append(ends, stop)
    return ends


def index_units(data: np.ndarray, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
    """Count the units of a text's UTF-8 bytes and keep the checkpoints."""
    n, points = 0, 0
    at_bytes, at_points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for start in range(0, len(data), block):
        stop = min(start + block, len(data))
        ends = _ends(data, start, stop)
        marked = ends[every - 1 - n % every :: every]
        if len(marked):
            begins = np.concatenate(([0], np.cumsum((data[start:stop] & 0xC0) != 0x80)))
            at_bytes.append(marked)
            at_points.append(points + begins[marked - start])
        points += _points(data[start:stop])
        n += len(ends)
    return Checkpoints(n, every, np.concatenate(at_bytes), np.concatenate(at_points))


def locate(data: np.ndarray, index: Checkpoints, units: int, step: int = STEP) -> tuple[int, int]:
    """Bytes and code points before the end of the first ``units`` units."""
    k = int(np.searchsorted(np.arange(len(index.at_bytes)) * index.every, units, "right")) - 1
    at, points, left = int(index.at_bytes[k]), int(index.at_points[k]), units - k * index.every
    while left:
        stop = min(at + step, len(data))
        ends = _ends(data, at, stop)
        cut = int(ends[left - 1]) if len(ends) >= left else stop
        left -= min(left, len(ends))
        points += _points(data[at:cut])
        at = cut
    return at, points


def _transform(data: bytes, h1: int, h2: int, form: str | None) -> tuple[int, str, int | None, int | None, bytes]:
    raw = np.frombuffer(data, np.uint8)
    index = index_units(raw)
    n = index.n_units
    if not data or form is None or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    (b1, c1), (b2, c2) = (locate(raw, index, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:b1], data[b1:b2], data[b2:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return n, form, c1, c2 - c1, out


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): of a hundred texts about ``rate``
    are transformed, and of a hundred of those ``spm_rate`` with the suffix first."""
    bound_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    form = F.when(group(2) % 100 < rate, F.when(group(3) % 100 < spm_rate, "spm").otherwise("psm"))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)))
            rows = [_transform((value.as_py() or "").encode(), h1, h2, f) for value, h1, h2, f in wanted]
            n, forms, first, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                [key, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    picked = docs.select(F.col(key), F.col(text), group(0).alias("_h1"), group(1).alias("_h2"), form.alias("_form"))
    return picked.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output, from the output and its form alone."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))
