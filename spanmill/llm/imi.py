"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by its own centroids; a pair of centroids is
a cell.  The distance of a query to a cell is the sum of its halves' negative
inner products with the two centroids, so the order of cells is that of the
score itself.  A heap takes runs of ``RUN`` cells of one first centroid in the
order of that sum, until the next run lies beyond the query's cutoff; then the
entries of the opened cells are reranked with the exact inner product.  Where
the opened cells hold fewer than k entries besides the query, the heap goes on
until they hold as many.

The cutoff is the query's own: its k-th best score is estimated from a sample,
and a margin below it is allowed that keeps ``TARGET`` of the true neighbours,
by bins of that score.  So a query in a dense neighbourhood opens few cells,
and one without near neighbours many.  Centroids, margins and the estimate
come from at most ``SAMPLE`` vectors (in the order of a hash of their ids).
Where the table is larger, a third of the sample is held out from the centroids
and the margins are taken from it.  Every vector is indexed.

First centroids that lie near each other form a group; a group's entries are
dealt in blocks of about ``BLOCK`` rows, and so are the queries that open cells
of it, so a crowded group spreads over tasks and a query is sent once to each
block that it opens cells of.  Each block keeps the exact best k of its opened
entries (ties: smaller vec_id), so merging the blocks loses nothing.

Vectors that are null, zero or hold null or non-finite components take no part;
so do null ids.  Vectors of different dimensions are searched apart, each
dimension by its own index.  Of rows that repeat an id the one with the
smallest vector counts.  Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import discard, materialize

SAMPLE = 12_000
TRIALS = 400
TARGET = 0.92
#: Centroids a half, at most; and the entries for each at least.
CENTROIDS, PER_CENTROID = 512, 8
RUN = 16
BLOCK = 4096
BINS = 5
SCHEMA = "query_id long, rank int, vec_id long, score double"


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T, axis=1)


def centroids_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced sample rows."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    #: the sample, for estimates of a query's k-th best score
    sample: np.ndarray
    sample_ids: np.ndarray
    #: which of the sample's scores stands for the k-th best of all
    place: int = 1
    #: upper ends of the bins of estimated scores, and how far below each the cutoff lies
    ends: np.ndarray = field(default_factory=lambda: np.array([np.inf]))
    margins: np.ndarray = field(default_factory=lambda: np.array([np.inf]))
    #: entries in each cell, by first and second centroid
    sizes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return x[..., :cut], x[..., cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.halves(x)
        return nearest(left, self.first), nearest(right, self.second)

    def orders(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the query's halves to the centroids."""
        left, right = self.halves(query)
        return -(self.first @ left), -(self.second @ right)

    def expected(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th best score of each query, estimated from the sample without the query."""
        scores = np.where(ids[:, None] == self.sample_ids[None, :], -np.inf, queries @ self.sample.T)
        place = min(self.place, scores.shape[1])
        return np.partition(scores, -place, axis=1)[:, -place]

    def cutoff(self, expected: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ends, expected), len(self.margins) - 1)
        return -(expected - self.margins[at])

    def visit(self, query: np.ndarray, cutoff: float, least: int) -> np.ndarray:
        """For each first centroid, how many of the second ones (in the query's order) are opened."""
        left, right = self.orders(query)
        rows, columns = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        left, right = left[rows], right[columns]
        opened, have = np.zeros(len(left), np.int32), 0
        heap = [(left[0] + right[0], 0, 0)]
        while heap and (heap[0][0] <= cutoff or have < least):
            _, i, j = heapq.heappop(heap)
            stop = min(j + RUN, len(right))
            opened[rows[i]] = stop
            if have < least:
                have += int(self.sizes[rows[i], columns[j:stop]].sum())
            if stop < len(right):
                heapq.heappush(heap, (left[i] + right[stop], i, stop))
            if not j and i + 1 < len(left):
                heapq.heappush(heap, (left[i + 1] + right[0], i + 1, 0))
        return opened

    def ranks(self, query: np.ndarray) -> np.ndarray:
        """Place of each second centroid in the query's order."""
        order = np.argsort(self.orders(query)[1], kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out


def best(query: np.ndarray, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and ids of the best k by ``rough`` scores, which may be off by rounding."""
    if len(ids) > k:
        edge = np.partition(rough, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        near = np.arange(len(ids))
    exact = (x[near] * query).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return exact[order], ids[near][order]


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(sound & F.col("vec_id").isNotNull())


def fit(rows: DataFrame, total: int, k: int, sample: int = SAMPLE, target: float = TARGET) -> MultiIndex:
    """Centroids, estimates and margins from a bounded sample; sizes are still to be set."""
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x, ids = np.array(held["v"].to_list(), float), held["vec_id"].to_numpy()
    whole = total <= len(x)
    train = len(x) if whole else 2 * len(x) // 3
    half, n = x.shape[1] // 2, int(min(CENTROIDS, max(4, train // PER_CENTROID), train))
    index = MultiIndex(centroids_of(x[:train, :half], n), centroids_of(x[:train, half:], n), x, ids, max(1, -(-k * len(x) // total)))

    # margins: how far below its query's estimated score the cell of a true neighbour lies
    others = np.arange(len(x)) if whole else np.arange(train, len(x))
    tries = np.arange(0, len(x), max(1, len(x) // TRIALS))
    expected = index.expected(x[tries], ids[tries])
    a, b = index.cells(x[others])
    near = max(1, -(-k * len(others) // total))
    gaps = []
    for q, e in zip(tries, expected):
        left, right = index.orders(x[q])
        score = np.where(others == q, -np.inf, x[others] @ x[q])
        true = np.argsort(-score, kind="stable")[: min(near, len(others) - 1)]
        gaps.append(e + (left[a[true]] + right[b[true]]))
    if len(x) > 1:
        order = np.argsort(expected, kind="stable")
        parts = [p for p in np.array_split(order, min(BINS, max(1, len(order) // 40))) if len(p)]
        index.ends = np.array([expected[p[-1]] for p in parts[:-1]] + [np.inf])
        index.margins = np.array([np.quantile(np.concatenate([gaps[i] for i in p] or [np.zeros(1)]), target) if any(len(gaps[i]) for i in p) else np.inf for p in parts])
    return index


def search(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest found for each row whose id is divisible by ``every``:
    (query_id, rank, vec_id, score), by inner product in double precision."""
    rows = vectors(table, key, column)
    if _repeats(rows):
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    out = None
    for size in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # a row a dimension
        found = _search(rows.where(F.size("v") == size.n), size["count"], k, every)
        out = found if out is None else out.unionByName(found)
    return table.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _search(rows: DataFrame, total: int, k: int, every: int) -> DataFrame:
    index = fit(rows, total, k)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                f["c1"], f["c2"] = index.cells(np.array(f["v"].to_list()))
                yield f

    entries = materialize(rows.mapInPandas(assign, "vec_id long, v array<double>, c1 int, c2 int"))
    index.sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # at most CENTROIDS ** 2 rows
        index.sizes[r.c1, r.c2] = r["count"]
    groups = int(min(len(index.first), max(1, -(-total // (2 * BLOCK)))))
    group_of = nearest(index.first, centroids_of(index.first, groups))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), 256):
                ids, x = f["vec_id"].to_numpy()[at : at + 256], np.array(f["v"].iloc[at : at + 256].to_list())
                for query_id, v, cutoff in zip(ids, x, index.cutoff(index.expected(x, ids))):
                    opened = index.visit(v, cutoff, k + 1)
                    out += [(query_id, v, g, opened[group_of == g]) for g in np.unique(group_of[opened > 0])]
            yield pd.DataFrame(out, columns=["query_id", "v", "g", "opened"])

    queries = materialize(entries.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInPandas(plan, "query_id long, v array<double>, g int, opened array<int>"))
    asked = {r.g: r["count"] for r in queries.groupBy("g").count().collect()}  # a row a group at most
    if not asked:
        discard(entries, queries)
        return rows.sparkSession.createDataFrame([], SCHEMA)
    e_blocks = {g: int(max(1, -(-index.sizes[group_of == g].sum() // BLOCK))) for g in asked}
    q_blocks = {g: max(1, -(-n // BLOCK)) for g, n in asked.items()}

    def blocks(of: dict[int, int]):
        return F.element_at(F.create_map(*(F.lit(int(x)) for pair in of.items() for x in pair)), F.col("g"))

    group = F.get(F.array(*(F.lit(int(g)) for g in group_of)), F.col("c1"))
    dealt = entries.withColumn("g", group).where(F.col("g").isin(list(asked)))
    dealt = dealt.withColumn("e", F.pmod(F.xxhash64("vec_id"), blocks(e_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), blocks(q_blocks) - 1)))
    asking = queries.withColumn("q", F.pmod(F.xxhash64("query_id"), blocks(q_blocks)).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), blocks(e_blocks) - 1)))
    place_in_group = np.zeros(len(group_of), np.int64)
    for g in asked:
        place_in_group[group_of == g] = np.arange((group_of == g).sum())

    def rerank(key: tuple, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(e):
            x, ids, c2 = np.array(e["v"].to_list()), e["vec_id"].to_numpy(), e["c2"].to_numpy()
            c1 = place_in_group[e["c1"].to_numpy()]
            for query_id, v, opened in zip(q["query_id"], q["v"], q["opened"]):
                use = np.flatnonzero((index.ranks(v)[c2] < opened[c1]) & (ids != query_id))
                if len(use):
                    score, near = best(v, ids[use], x[use], x[use] @ v, k)
                    found += zip([query_id] * len(near), near, score)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = asking.groupBy("g", "e", "q").cogroup(dealt.groupBy("g", "e", "q")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = materialize(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(entries, queries)
    return out


def _repeats(rows: DataFrame) -> bool:
    return rows.groupBy("vec_id").count().where("count > 1").limit(1).count() > 0
