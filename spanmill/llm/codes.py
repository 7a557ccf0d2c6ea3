"""Product codes of vectors, with annular norm pruning.

Components become integers, vectors are cut into equal parts, and each part
position learns a codebook by Lloyd rounds.  Entries are sorted by norm; a part
takes the entry whose norm is nearest as its first guess and then looks only
at entries whose norm differs from its own by no more than the best distance
so far (by the triangle inequality no other can be nearer), evaluated exactly
in integers.  The interval is found by binary search, ends included, and
narrows as the best distance falls, so assignments are those of a full search.

Each round is one Spark job: tasks assign their rows and add them up, sums meet
by (part, entry, place), and the driver gets ``parts x entries x width`` sums,
whatever the number of rows.

Vectors that are null or hold null or non-finite components take no part, nor do
those whose length is not that of the first kept one (by id) or cannot be cut evenly.
Fewer vectors than entries give fewer entries.  Null ids come last, rows sharing
an id are ordered by their components.  Components beyond 32,768 in magnitude are
refused, since distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest magnitude of an integer component.
LARGEST = 1 << 27


class Ring(NamedTuple):
    """The entries of a part's codebook by norm."""

    entries: np.ndarray
    norms: np.ndarray
    index: np.ndarray


def ring(entries: np.ndarray) -> Ring:
    norms = np.sqrt((entries * entries).sum(1).astype(float))
    order = np.argsort(norms, kind="stable")
    return Ring(entries[order], norms[order], order)


def nearest(parts: np.ndarray, by_norm: Ring) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of ``parts`` (ties: the lower index), its squared
    distance, and how many distances were evaluated."""
    norm = np.sqrt((parts * parts).sum(1).astype(float))
    right = np.searchsorted(by_norm.norms, norm).clip(0, len(by_norm.norms) - 1)
    left = (right - 1).clip(0)
    guess = np.where(np.abs(by_norm.norms[left] - norm) <= np.abs(by_norm.norms[right] - norm), left, right)
    gap = parts - by_norm.entries[guess]
    best, index = (gap * gap).sum(1), by_norm.index[guess]
    slack = 1e-9 * (norm + by_norm.norms[-1]) + 1e-6
    reach = np.sqrt(best.astype(float)) + slack
    low = np.searchsorted(by_norm.norms, norm - reach, "left")
    high = np.searchsorted(by_norm.norms, norm + reach, "right")
    done = len(parts)
    for e in range(int(low.min(initial=0)), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= e) & (e < high) & (guess != e))
        rows = rows[np.abs(by_norm.norms[e] - norm[rows]) <= reach[rows]]
        gap = parts[rows] - by_norm.entries[e]
        found, name = (gap * gap).sum(1), by_norm.index[e]
        done += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (name < index[rows]))
        rows, found = rows[better], found[better]
        best[rows], index[rows] = found, name
        reach[rows] = np.sqrt(found.astype(float)) + slack[rows]
    return index, best, done


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), -1)


def _assigned(matrix: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = books.shape[2]
    for p in range(len(books)):
        part = np.ascontiguousarray(matrix[:, p * width : (p + 1) * width])
        yield p, part, *nearest(part, ring(books[p]))[:2]


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, v array<long>) of the rows that take part."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.coalesce(usable, F.lit(False)) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    whole = kept.select(F.col(key), F.col(label), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    first = whole.orderBy(F.col(key).asc_nulls_last(), "v").limit(1).select(F.size("v").alias("_width"))
    return whole.join(F.broadcast(first), F.size("v") == F.col("_width")).drop("_width")


def fit_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id") -> np.ndarray:
    """Codebooks (part, entry, place) after ``rounds`` rounds over all rows."""
    seeds = [r.v for r in whole.orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    if whole.where(F.exists("v", lambda x: F.abs(x) > LARGEST)).limit(1).count():
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        held = books

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*held.shape[:2], held.shape[2] + 1), np.int64)
            for batch in batches:
                if batch.num_rows:
                    for p, part, index, _ in _assigned(_matrix(batch.column(0)), held):
                        np.add.at(total[p], index, np.concatenate((part, np.ones((len(part), 1), np.int64)), 1))
            place = np.flatnonzero(np.repeat(total[..., -1] > 0, total.shape[2]))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place], pa.int64())], ["place", "total"])

        met = whole.select("v").mapInArrow(add_up, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in met:
            total.ravel()[r.place] = r.total
        used = total[..., -1] > 0
        books = books.copy()
        books[used] = total[used][:, :-1] // total[used][:, -1:]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(whole: DataFrame, books: np.ndarray, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, code, error): two hex digits a part, squared distances summed."""
    kinds = dict(whole.dtypes)
    if books.shape[1] > 256:
        raise ValueError("two hex digits name 256 entries at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            if n:
                for p, _, index, far in _assigned(_matrix(batch.column(2)), books):
                    code[:, p] = index
                    error += far
            names = [bytes(row).hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(error, pa.int64())], [key, label, "code", "error"])

    return whole.select(key, label, "v").mapInArrow(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for every vector that takes part.
    Codes and sums by label are written tables, so a label with a third of all rows is
    added up before it is shuffled and its partition of the join can be split."""
    whole = materialize(integer_vectors(vectors, parts, scale, key, vector, label))
    books = fit_codebooks(whole, parts, entries, rounds, key)
    coded = materialize(encode(whole, books, key, label))
    by_label = materialize(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(by_label, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
