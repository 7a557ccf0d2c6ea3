"""Ranks and nearest rows over pairs, compared block by block in numpy inside tasks.

Queries and candidates of a scope are dealt into blocks by a hash.  Spark groups every
block of queries with every block of candidates; a group holds ``BLOCK`` rows of
either side, about, and is compared tile by tile (attributes and minutes: by binary search),
so memory is bounded and work is spread whatever a scope's size.  A group returns a row a query (ranks) or its k best (nearest),
never pairs: what is shuffled is rows times the blocks of the other side.

Scores are compared as if rounded to ``digits``; ties go to the smaller entity.  A vector that is
null or holds a null has cosine 0 with every other and is never near by distance; a NaN
comes after every number.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block on either side, blocks that a scope of some size has at least, and queries and candidates of a tile.
BLOCK, LEAST, QUERIES, CANDIDATES = 16384, 8, 64, 4096
#: The score of a NaN, below every other and above what takes no part.
UNKNOWN = -1e300


def _grouped(queries: DataFrame, candidates: DataFrame, scope: str | None, entity: Sequence[str], kernel, schema: str) -> DataFrame:
    """``kernel`` of every block of queries with every block of candidates of its scope."""
    place = F.col(scope) if scope else F.lit(0)
    sides = [x.withColumn("_scope", place).where("_scope is not null") for x in (queries, candidates)]
    count = lambda x, name: x.groupBy("_scope").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.lit(LEAST), F.ceil(F.count("*") / 1024))).cast("int").alias(name))
    sizes = count(sides[0], "_na").join(count(sides[1], "_nb"), "_scope")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*entity), F.col(f"_n{mine}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))
        met = rows.join(sizes, "_scope").withColumn(f"_{mine}", block).withColumn(f"_{other}", every).drop("_na", "_nb")
        return met.select(*(F.col(c).alias(c) for c in met.columns))  # columns of their own, since both sides may be one table

    keys = ["_scope", "_a", "_b"]
    return dealt(sides[0], "a", "b").groupBy(*keys).cogroup(dealt(sides[1], "b", "a").groupBy(*keys)).applyInArrow(kernel, schema)


def _whole(v: Column) -> Column:
    """The vector, null if a component is."""
    return F.when(~F.exists(v, lambda x: x.isNull()), v.cast("array<double>"))


def _matrix(column: pa.ChunkedArray, missing: float) -> np.ndarray:
    """Rows of equal length; null vectors are filled with ``missing``."""
    held = column.combine_chunks()
    there = np.asarray(held.is_valid())
    flat = pc.list_flatten(held).to_numpy(zero_copy_only=False)
    size = len(flat) // max(int(there.sum()), 1)
    if (np.asarray(pc.list_value_length(held.drop_null())) != size).any():
        raise ValueError("vectors differ in length")
    out = np.full((len(there), size), missing)
    out[there] = flat.reshape(-1, size)
    return out


def _positions(left: pa.Table, right: pa.Table, entity: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides' rows by entity; a query comes before the candidate of its entity."""
    both = pa.concat_tables([left.select(list(entity)), right.select(list(entity))])
    order = np.asarray(pc.sort_indices(both, sort_keys=[(e, "ascending") for e in entity]))
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return at[: left.num_rows], at[left.num_rows :]


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two columns; a null equals nothing."""
    both = pa.chunked_array(left.chunks + right.chunks, left.type).combine_chunks().dictionary_encode().indices
    code = both.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    a, b = code[: len(left)].copy(), code[len(left) :]
    a[a < 0] = -2
    return a, b


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size != 0)


def _scorer(metric: str, left: pa.Table, right: pa.Table, order: np.ndarray):
    """score(queries, candidates) of two slices, larger is nearer; candidates are put in ``order``."""
    if not left.num_rows or not right.num_rows:
        return None
    fill = 0.0 if metric == "cosine" else np.nan
    q, c = _matrix(left["v"], fill), _matrix(right["v"], fill)[order]
    size = max(q.shape[1], c.shape[1])
    q, c = (x if x.shape[1] else np.full((len(x), size), fill) for x in (q, c))  # a side of nulls alone
    if metric == "cosine":
        with np.errstate(invalid="ignore"):
            q, c = _units(q), np.ascontiguousarray(_units(c).T)
        return lambda i, j: q[i] @ c[:, j]
    c = np.ascontiguousarray(c.T)

    def distance(i: slice, j: slice) -> np.ndarray:
        total = 0.0
        for k in range(size):
            gap = q[i, k, None] - c[k, None, j]
            gap *= gap
            total = total + gap
        return -np.sqrt(total)

    return distance


def _tiles(n: int, size: int):
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _counted(mask: np.ndarray) -> np.ndarray:
    """True values by row; rows are contiguous and a multiple of eight long where it can be."""
    if mask.shape[1] % 8:
        return mask.sum(1)
    return np.bitwise_count(mask.view(np.uint64)).sum(1, dtype=np.int64)


def _ties(mask: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Candidates of a smaller entity by row."""
    rows, columns = np.nonzero(mask)
    return np.bincount(rows[c[columns] < q[rows]], minlength=len(q))


def vector_ranks(own: DataFrame, candidates: DataFrame, entity: list[str], metric: str, digits: int, scope: str | None = None, apart: str | None = None) -> DataFrame:
    """(entity, better, pool): how many candidates of the scope beat a query's own row, and how many there are.

    ``own`` has the entity, v, the scope and ``mine``, the own row's rounded score (larger is
    nearer).  ``apart`` is an attribute: candidates that share it, or where it is null, are left out."""
    kinds = dict(own.dtypes)
    out_schema = ", ".join(f"`{e}` {kinds[e]}" for e in entity) + ", better long, pool long"
    scale = 10.0**digits

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        better, pool = np.zeros(n, np.int64), np.full(n, m, np.int64)
        score = _scorer(metric, left, right, np.arange(m))
        if score:
            mine = left["mine"].to_numpy()
            lost = np.isnan(mine)
            t = np.rint(np.where(lost, 0, mine) * scale)
            high, low = (t + 0.5) / scale, (t - 0.5) / scale
            high = np.where(t < 0, np.nextafter(high, np.inf), high)  # halves are rounded away from 0
            low = np.where(t <= 0, np.nextafter(low, np.inf), low)
            high[lost] = low[lost] = np.inf
            qp, cp = _positions(left, right, entity)
            if apart:
                qa, ca = _codes(left[apart], right[apart])
                same = np.bincount(ca[ca >= 0], minlength=max(qa.max(initial=0), ca.max(initial=0)) + 1)
                pool = np.where(qa < 0, 0, m - (ca < 0).sum() - same[np.maximum(qa, 0)])
            for i in _tiles(n, QUERIES):
                for j in _tiles(m, CANDIDATES):
                    s = score(i, j)
                    above, level = s >= high[i, None], s >= low[i, None]
                    if apart:
                        other = (qa[i, None] != ca[None, j]) & (qa[i, None] >= 0) & (ca[None, j] >= 0)
                        above &= other
                        level &= other
                    count = _counted(above)
                    better[i] += count
                    if (_counted(level) > count).any():
                        better[i] += _ties(level ^ above, qp[i], cp[j])
            for i in np.flatnonzero(lost):
                s = score(slice(i, i + 1), slice(0, m))[0]
                taken = np.ones(m, bool) if not apart else (qa[i] != ca) & (qa[i] >= 0) & (ca >= 0)
                better[i] = (taken & (~np.isnan(s) | (cp < qp[i]))).sum()
        return pa.table([*(left[e] for e in entity), pa.array(better), pa.array(pool)], names=[*entity, "better", "pool"])

    more = [apart] if apart else []
    scoped = [scope] if scope and scope not in [*entity, *more] else []
    asked = own.select(*entity, *more, *scoped, "mine", _whole(F.col("v")).alias("v"))
    pool = candidates.select(*entity, *more, *scoped, _whole(F.col("v")).alias("v"))
    return _grouped(asked, pool, scope, entity, kernel, out_schema)


def _parts(level: int, n: int):
    """(sign, attributes): the candidates that are unequal in just the attributes of ``level`` (binary digits,
    the first highest) are these groups' sum, of candidates equal in the attributes, whatever the others are."""
    places = range(n)
    ones = [k for k in places if level >> (n - 1 - k) & 1]
    for size in range(len(ones) + 1):
        for more in combinations(ones, size):
            yield (-1) ** size, [k for k in places if k not in ones or k in more]


def _first(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """The first place from ``low`` on at which ``holds`` is true, or ``high``, by row; it is false, then true."""
    low, high = low.copy(), high.copy()
    while (left := low < high).any():
        middle = (low + high) >> 1
        yes = holds(np.where(left, middle, 0))
        high = np.where(left & yes, middle, high)
        low = np.where(left & ~yes, middle + 1, low)
    return low


def _nearer(at: np.ndarray, codes: list[tuple], q: np.ndarray, c: np.ndarray, gap: np.ndarray, qp: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates with equal codes, for the queries ``at``: how many there are, and how many are nearer
    in minutes than ``gap``, or as near and of a smaller entity.  Candidates are sorted once and searched."""
    mine, other = np.zeros(len(q), np.int64), np.zeros(len(c), np.int64)
    for a, b in codes:
        size = int(max(a.max(initial=0), b.max(initial=0))) + 3
        mine, other = mine * size + a + 2, other * size + b + 2
    mine, q, gap, qp = mine[at], q[at], gap[at], qp[at]
    bounds = lambda keys: (np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right"))
    start, stop = bounds(np.sort(other))
    met = stop - start
    order = np.lexsort((cp, c, other))
    order = order[~np.isnan(c[order])]
    keys, minutes, place = other[order], c[order], cp[order]
    start, stop = bounds(keys)

    def earlier(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        count = _first(low, high, lambda x: place[x] >= qp) - low  # of equal minutes in the order of entities
        some = np.flatnonzero(high > low)
        for i in some[minutes[low[some]] != minutes[high[some] - 1]]:  # minutes whose rounded distances are equal
            count[i] = (place[low[i] : high[i]] < qp[i]).sum()
        return count

    with np.errstate(invalid="ignore"):
        left = _first(start, stop, lambda x: q - minutes[x] <= gap), _first(start, stop, lambda x: q - minutes[x] < gap)
        right = _first(start, stop, lambda x: minutes[x] - q >= gap), _first(start, stop, lambda x: minutes[x] - q > gap)
        closer = np.maximum(right[0] - left[1], 0) + earlier(*left) + np.where(gap > 0, earlier(*right), 0)
        for i in np.flatnonzero(~np.isfinite(q)):  # distances from an infinity don't ascend
            far = np.abs(q[i] - minutes[start[i] : stop[i]])
            closer[i] = ((far < gap[i]) | (far == gap[i]) & (place[start[i] : stop[i]] < qp[i])).sum()
    return met, closer


def profile_ranks(own: DataFrame, candidates: DataFrame, entity: list[str], exact: Sequence[str], scope: str | None = None) -> DataFrame:
    """(entity, better, pool) by equal attributes in turn, then the nearest ``minutes``, then the entity.
    ``own`` has the entity, attributes, minutes, the scope, and of the own row ``level`` (its unequal
    attributes as binary digits) and ``gap`` (the distance in minutes)."""
    kinds = dict(own.dtypes)
    out_schema = ", ".join(f"`{e}` {kinds[e]}" for e in entity) + ", better long, pool long"
    exact = list(exact)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        better = np.zeros(n, np.int64)
        if n and m:
            codes = [_codes(left[a], right[a]) for a in exact]
            q, c = left["minutes"].to_numpy(), right["minutes"].to_numpy()
            level, gap = left["level"].to_numpy(), left["gap"].to_numpy()
            qp, cp = _positions(left, right, entity)
            for mine in np.unique(level):
                at = np.flatnonzero(level == mine)
                for lower in range(mine + 1):
                    for sign, equal in _parts(lower, len(exact)):
                        met, closer = _nearer(at, [codes[k] for k in equal], q, c, gap, qp, cp)
                        better[at] += sign * (met if lower < mine else closer)
        return pa.table([*(left[e] for e in entity), pa.array(better), pa.array(np.full(n, m))], names=[*entity, "better", "pool"])

    scoped = [scope] if scope and scope not in [*entity, *exact] else []
    minutes = F.col("minutes").cast("double").alias("minutes")
    asked = own.select(*entity, *exact, *scoped, minutes, F.col("level").cast("tinyint").alias("level"), F.col("gap").cast("double").alias("gap"))
    return _grouped(asked, candidates.select(*entity, *exact, *scoped, minutes), scope, entity, kernel, out_schema)


def nearest(queries: DataFrame, candidates: DataFrame, entity: list[str], k: int, metric: str, digits: int, scope: str | None = None, human: str | None = None) -> DataFrame:
    """(entity, neighbor_<e>, score): the k nearest of each query in every block of candidates, larger
    scores nearer.  With ``human`` candidates of the same value are left out, and rows
    without one take no part."""
    kinds = dict(candidates.dtypes)
    mine = ", ".join(f"`{e}` {dict(queries.dtypes)[e]}" for e in entity)
    out_schema = mine + ", " + ", ".join(f"`neighbor_{e}` {kinds[e]}" for e in entity) + ", score double"
    names = [*entity, *(f"neighbor_{e}" for e in entity), "score"]
    scale = 10.0**digits

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        _, cp = _positions(left, right, entity)
        order = np.argsort(cp)  # candidates by entity, so the earlier of two wins a tie
        score = _scorer(metric, left, right, order)
        if human and score:
            qh, ch = _codes(left[human], right[human])
            ch = ch[order]
        held: list[tuple] = []
        for i in _tiles(n if score else 0, QUERIES):
            rows_here = i.stop - i.start
            best, place = np.full((rows_here, k), -np.inf), np.full((rows_here, k), m)
            for j in _tiles(m, CANDIDATES):
                s = score(i, j)
                np.copyto(s, UNKNOWN / scale, where=np.isnan(s))
                if human:
                    s[(qh[i, None] == ch[None, j])] = -np.inf
                if j.start == 0 and s.shape[1] > k:
                    s = np.rint(s * scale)
                    wanted = s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]
                else:
                    s *= scale
                    wanted = s >= (best[:, -1:] + 0.5)
                rows, columns = np.nonzero(wanted)
                if not len(rows):
                    continue
                value = np.concatenate([best.ravel(), np.rint(s[rows, columns])])
                at = np.concatenate([place.ravel(), columns + j.start])
                row = np.concatenate([np.repeat(np.arange(rows_here), k), rows])
                sorted_rows = np.lexsort((at, -value, row))
                sizes = np.bincount(row, minlength=rows_here)
                chosen = sorted_rows[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]
                best, place = value[chosen], at[chosen]
            there = best > -np.inf
            held.append((np.nonzero(there)[0] + i.start, order[place[there]], best[there]))
        q, c, value = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        value = np.where(value <= UNKNOWN / 2, np.nan, value / scale)
        return pa.table([*(left[e].take(pa.array(q)) for e in entity), *(right[e].take(pa.array(c)) for e in entity), pa.array(value, pa.float64())], names=names)

    more = [human] if human and human not in entity else []
    scoped = [scope] if scope and scope not in [*entity, *more] else []
    side = lambda rows: rows.select(*entity, *more, *scoped, _whole(F.col("v")).alias("v"))
    asked, pool = side(queries), side(candidates)
    if human:
        asked, pool = asked.where(F.col(human).isNotNull()), pool.where(F.col(human).isNotNull())
    return _grouped(asked, pool, scope, entity, kernel, out_schema)
