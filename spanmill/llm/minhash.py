"""Near-duplicate grouping with circulant MinHash.

Two fixed permutations of the 32-bit circle make all signature coordinates: the
first places a shingle, coordinate k takes the second at that place shifted by
k.  Rows of five coordinates form bands; documents that share a band are
candidates, and every link is confirmed on the full shingle sets.

Documents with equal sets form a class that one member stands for, so groups
of exact copies cost a row each and no pairs.  In a bucket, members are first
confirmed against the bucket's smallest class.  In buckets that then still hold
several components, the members outside of the largest one are leaders again:
each is compared with the bucket's members in other components, in blocks of
bounded weight, and a block returns a spanning forest of its links, never all
its pairs.  Classes with too many shingles of their own to reach the threshold
with any other candidate are left out before.

A pair right at the threshold shares no band with a probability of ``miss``
(1e-5); that is the only way in which a link can be lost.

Hot keys: buckets, classes and hubs are aggregated partially before they are
shuffled, and every join on such a key has both sides straight from written
tables, so adaptive execution splits its heavy partitions.

Null texts and texts without words have the empty set and link with nothing.
Rows sharing a doc_id count as one document, linked through any of its rows,
and get one component; rows with a null doc_id take no part (component null,
kept).  Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bound_batches, connected_components, discard, materialize
from spanmill.llm.wordhash import U, mix64, shingle_sets

ROWS = 5
#: Classes in a block, and shingles of them together, about.
BLOCK, WEIGHT = 256, 1 << 21
STEP = 1 << 17


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands with which a pair right at the threshold is missed with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def signatures(hashes: np.ndarray, lengths: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of consecutive non-empty sets: (sets, coordinates) uint32."""
    place = (mix64(hashes ^ U(0xA0761D6478BD642F)) >> U(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty((len(lengths), coordinates), np.uint32)
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + STEP, "right")) - 1)
        part = place[starts[first] : starts[last]]
        at = starts[first:last] - starts[first]
        for k in range(coordinates):
            x = part - np.uint32(k)
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            out[first:last, k] = np.minimum.reduceat(x, at)
        first = last
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), U)
    for r in range(rows):
        keys = mix64(keys * U(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands].astype(U) + U(1))
    return keys + np.arange(bands, dtype=U)[None, :] * U(0xD1342543DE82EF95)


def _sketch_rows(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, hashes, lengths in shingle_sets(batch.column("text"), width):
                full = lengths > 0
                starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][full]
                one, two = np.zeros(len(lengths), U), np.zeros(len(lengths), U)
                keys = np.zeros((0, bands), U)
                if full.any():
                    one[full] = np.add.reduceat(mix64(hashes), starts)
                    two[full] = np.add.reduceat(mix64(hashes + U(0x632BE59BD9B4E019)), starts)
                    keys = _band_keys(signatures(hashes, lengths[full], bands * rows), bands, rows)
                offsets = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(lengths)),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "one", "two", "bands"],
                )

    return run


def _set_rows(width: int):
    """(cid, rep, shingles) of the texts whose set is that of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = np.asarray(batch.column("one")).view(U)
            for first, hashes, lengths in shingle_sets(batch.column("text"), width):
                full = lengths > 0
                ends = np.concatenate(([0], np.cumsum(lengths)))
                one = np.zeros(len(lengths), U)
                if full.any():
                    one[full] = np.add.reduceat(mix64(hashes), ends[:-1][full])
                own = pa.array(full & (one == expected[first : first + len(lengths)]))
                rows = [c.slice(first, len(lengths)) for c in (batch.column("cid"), batch.column("rep"))]
                rows.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64))))
                yield pa.RecordBatch.from_arrays(rows, ["cid", "rep", "shingles"]).filter(own)

    return run


def common_sizes(left: list[np.ndarray], right: list[np.ndarray], dense: int = 64, step: int = 2048) -> np.ndarray:
    """(left, right) sizes of the intersections of sets of integers, as a product of two
    sparse matrices: values that few pairs share are expanded, others multiplied densely."""
    rows, columns = len(left), len(right)
    out = np.zeros(rows * columns, np.int64)
    lv, li = np.concatenate(left), np.repeat(np.arange(rows), [len(x) for x in left])
    rv, rj = np.concatenate(right), np.repeat(np.arange(columns), [len(x) for x in right])
    order = np.argsort(lv, kind="stable")
    lv, li = lv[order], li[order]
    values, start, p = np.unique(lv, return_index=True, return_counts=True)
    if not len(values):
        return out.reshape(rows, columns)
    at = np.minimum(np.searchsorted(values, rv), len(values) - 1)
    found = values[at] == rv
    at, rj = at[found], rj[found]
    heavy = p * np.bincount(at, minlength=len(values)) > dense
    few = ~heavy[at]
    a, j = at[few], rj[few]
    ends = np.concatenate(([0], np.cumsum(p[a])))
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 21), "right")) - 1)
        n = p[a[first:last]]
        own = np.repeat(np.arange(first, last), n)
        within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(li[start[a[own]] + within] * columns + j[own], minlength=len(out))
        first = last
    both = out.reshape(rows, columns)
    place = np.cumsum(heavy) - 1
    left_value = np.repeat(np.arange(len(values)), p)
    for low in range(0, int(heavy.sum()), step):
        x, y = np.zeros((rows, step), np.float32), np.zeros((columns, step), np.float32)
        use = heavy[left_value] & (place[left_value] // step == low // step)
        x[li[use], place[left_value[use]] - low] = 1
        use = heavy[at] & (place[at] // step == low // step)
        y[rj[use], place[at[use]] - low] = 1
        both += (x @ y.T).astype(np.int64)
    return both


def _leader_links(percent: int):
    """Confirmed links between a block of leaders and a block of members in other components, as a spanning forest."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lead, rest = rows[rows["leader"]], rows[~rows["leader"]]
        out: list[tuple] = []
        if len(lead) and len(rest):
            x, y = lead["shingles"].to_list(), rest["shingles"].to_list()
            both = common_sizes(x, y)
            joint = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
            one, two = lead["component"].to_numpy(), rest["component"].to_numpy()
            good = (100 * both >= percent * joint) & (one[:, None] != two[None, :])
            root = {c: c for c in (*one, *two)}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            a, b = lead["rep"].to_numpy(), rest["rep"].to_numpy()
            for i, j in zip(*np.nonzero(good)):
                p, q = find(one[i]), find(two[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((a[i], b[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row per row.

    Links documents whose sets of ``width``-word shingles have
    100 * intersection >= percent * union."""
    bound_batches(docs.sparkSession)
    bands = bands_for(percent, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInArrow(_sketch_rows(width, bands, rows), "doc_id long, n_shingles long, one long, two long, bands array<long>"))

    # a class for each set, numbered; its smallest doc_id stands for it.  An id with several texts may
    # stand for several classes: all of them belong to one document
    classes = (
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "one", "two")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    repeats = materialize(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    repeated = repeats.limit(1).count() > 0
    same = _one_document(sketch, classes, repeats)

    spread = classes.select("cid", F.explode("bands").alias("key"))
    shared = materialize(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    members = materialize(spread.join(shared, "key"))

    # full sets, of candidates only
    wanted = classes.select("cid", "rep", "one").join(members.select("cid").distinct(), "cid")
    texts = docs.join(wanted, F.col("doc_id") == F.col("rep")).select("cid", "rep", "one", "text")
    sets = materialize(texts.mapInArrow(_set_rows(width), "cid long, rep long, shingles array<long>"))
    if repeated:
        once = materialize(sets.dropDuplicates(["cid"]))
        discard(sets)
        sets = once

    # a shingle that no other candidate has lowers every likeness of its owner; some owners can link with nothing
    lone = (
        sets.select("cid", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("cid").alias("cid"))
        .where("n = 1")
        .groupBy("cid")
        .agg(F.count("*").alias("lone"))
    )
    able = sets.select("cid", "rep", F.size("shingles").alias("n_shingles")).join(lone, "cid", "left")
    able = able.where(f"100 * (n_shingles - coalesce(lone, 0)) >= {percent} * n_shingles").select("cid", "rep", "n_shingles")
    live = materialize(members.join(able, "cid"))

    # every member against the smallest of its bucket
    mark = F.sum(F.xxhash64("cid").cast("decimal(20,0)"))
    leads = materialize(live.groupBy("key").agg(F.min(F.struct("rep", "cid", "n_shingles")).alias("lead"), F.count("*").alias("n"), mark.alias("mark")).where("n > 1"))
    pairs = (
        live.join(leads, "key")
        .where("rep <> lead.rep")
        .where(f"100 * least(n_shingles, lead.n_shingles) >= {percent} * greatest(n_shingles, lead.n_shingles)")
        .select(F.col("lead.cid").alias("a_cid"), F.col("cid").alias("b_cid"))
        .distinct()
    )
    left, right = (sets.select(F.col("cid").alias(f"{c}_cid"), F.col("rep").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    hit = F.size(F.array_intersect("a_set", "b_set"))
    confirmed = pairs.join(right, "b_cid").join(left, "a_cid").where(100 * hit >= percent * (F.size("a_set") + F.size("b_set") - hit))
    star = materialize(confirmed.select("a", "b").unionByName(same))
    joined = connected_components(star)

    # what is left apart: buckets with several components.  Buckets of the same members count once.
    once = leads.where("n > 2").groupBy("n", "mark").agg(F.min("key").alias("key")).select("key")
    apart = live.join(once, "key").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    apart = materialize(apart.select("key", "cid", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")))
    held = apart.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    most = F.max(F.struct("n", "weight", "component"))
    mixed = held.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(n: str, weight: str):
        return F.ceil(F.greatest(F.expr(n) / BLOCK, F.expr(weight) / WEIGHT)).cast("long")

    mixed = materialize(mixed.select("key", F.col("most.component").alias("largest"), blocks("n - most.n", "weight - most.weight").alias("i_all"), blocks("n", "weight").alias("j_all")))
    dealt = apart.join(mixed, "key")
    own = F.xxhash64("cid")

    def side(leader: bool, mine: str, other: str):
        rows = dealt.where("component <> largest") if leader else dealt
        at = rows.select("key", "cid", "rep", "component", F.lit(leader).alias("leader"), F.pmod(own, F.col(f"{mine}_all")).alias(mine), f"{other}_all")
        return at.select("key", "cid", "rep", "component", "leader", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_all") - 1)).alias(other))

    met = side(True, "i", "j").unionByName(side(False, "j", "i"))
    late = materialize(met.join(sets.select("cid", "shingles"), "cid").groupBy("key", "i", "j").applyInPandas(_leader_links(percent), "a long, b long"))
    merged = connected_components(star.unionByName(late))

    named = classes.select("n_shingles", "one", "two", "rep").join(merged.withColumnRenamed("id", "rep"), "rep", "left")
    named = materialize(named.select("n_shingles", "one", "two", F.coalesce("component", "rep").alias("of_class")))
    out = sketch.select("doc_id", "n_shingles", "one", "two").join(named, ["n_shingles", "one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("of_class")).otherwise(F.col("doc_id"))
    if repeated:  # a row without words may be of a document with others
        out = out.join(merged.select(F.col("id").alias("doc_id"), F.col("component").alias("of_doc")), "doc_id", "left")
        component = F.when(F.col("n_shingles") > 0, F.col("of_class")).otherwise(F.coalesce("of_doc", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(sketch, classes, repeats, shared, members, sets, live, leads, star, joined, apart, mixed, late, merged, named)
    return out


def _one_document(sketch: DataFrame, classes: DataFrame, repeats: DataFrame) -> DataFrame:
    """(a, b): ids that occur more than once, and what stands for each of their classes."""
    several = sketch.where("n_shingles > 0").join(repeats, "doc_id", "left_semi").select("doc_id", "n_shingles", "one", "two")
    named = several.join(classes.select("n_shingles", "one", "two", "rep"), ["n_shingles", "one", "two"])
    return named.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
