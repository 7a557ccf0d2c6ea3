"""Exact removal of repeated passages with suffix arrays of content-defined shards.

A window is a string of ``length`` bytes.  A text's windows are dealt into runs
by the smallest hash among the grams inside the window, so windows that are equal
have the same key wherever they stand, and only runs whose gram occurs again can
hold a repetition.  Those runs are cut out of their texts (with the bytes that
their last window needs), equal cuttings become one spelling with a count, and
spellings are dealt to tasks by key.  A task fills shards of bounded size.  Each
gets a suffix array by Larsson-Sadakane refinement (only groups still unsorted are
sorted again, by the rank that far ahead) and common prefixes by Kasai's
recurrence in its irreducible form; windows whose common prefix reaches ``length``
are repeated.  A key whose spellings fill several shards has its sorted
windows merged across them by binary search.  So no pair of shards has to be
compared that cannot share a window.

Skew: texts that are equal form a class that one document stands for, spellings
are aggregated before they are shuffled, and joins have written tables on both
sides.  A key with more than ``group_bytes`` of different spellings leaves the
tasks: its windows become rows with a 128-bit hash each, which are counted and
joined, so no group is gathered in one task.

Bytes are those of the text in UTF-8; a cut may fall inside a character, so what is
kept is binary.  Null texts are empty; texts shorter than ``length`` stay whole;
rows sharing an id, a null id among them, are documents of their own.  Equal
texts repeat each other wholly.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import bound_batches, discard, materialize

U = np.uint64
LENGTH = 200
#: Bytes of spellings that a shard holds before it is closed, and that one key may have in a task.
SHARD_BYTES, GROUP_BYTES = 1 << 19, 1 << 21
#: Windows of a run at most, so that a text of one letter is cut too; bytes of cuttings handed on together.
RUN_WINDOWS, HAND_ON = 1 << 14, 4 << 20
#: Windows of a text that are dealt into runs together, and the bits for a place among their grams.
CHUNK, PLACE = 1 << 19, U((1 << 20) - 1)

_SEEDS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes (8 or more), by halves."""
    left, right = (U(x) for x in _SEEDS[seed])

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x * left
        out ^= y * right
        out ^= out >> U(29)
        out *= U(0xD6E8FEB86659FD93)
        out ^= out >> U(32)
        return out

    eight = words(data, "<u8")[: max(0, len(data) - 7)]
    x, held = joined(eight, eight), 8
    while held < gram:
        ahead = min(held, gram - held)
        x, held = joined(x[:-ahead], x[ahead:]), held + ahead
    return x


def words(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from every place on as an integer; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), kind, padded, 0, (1,)).astype(U)


def runs(data: np.ndarray, length: int, gram: int, longest: int = RUN_WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and numbers of windows of the runs of a text, and whether
    the key's gram stands in the run more than once."""
    parts = [_runs(data[at : at + CHUNK + length - 1], length, gram, longest, at) for at in range(0, max(0, len(data) - length + 1), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)


def _runs(data: np.ndarray, length: int, gram: int, longest: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = gram_hashes(data, gram)
    # the low bits hold the place, so that of equal grams a window takes the leftmost
    least, held, width = (hashes & ~PLACE) | np.arange(len(hashes), dtype=U), 1, length - gram + 1
    while held < width:
        ahead = min(held, width - held)
        least, held = np.minimum(least[:-ahead], least[ahead:]), held + ahead
    taken = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    keys = hashes[(least[taken] & PLACE).astype(np.int64)]
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    begins, keys, more = taken[fresh], keys[fresh], np.diff(np.append(fresh, len(taken))) > 1
    sizes = np.diff(np.append(begins, len(least)))
    if sizes.max() > longest:
        pieces = -(-sizes // longest)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(begins, pieces) + nth * longest
        sizes = np.minimum(longest, np.repeat(begins + sizes, pieces) - starts)
        begins, keys, more = starts, np.repeat(keys, pieces), np.repeat(more, pieces)
    return keys.view(np.int64), begins + at, sizes, more


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the rank of each, by Larsson-Sadakane refinement:
    groups of suffixes that agree so far are sorted by the rank of the suffix
    that far ahead, which doubles the agreement; sorted ones are left alone."""
    n = len(data)
    first = words(data, ">u8")
    sa = np.argsort(first)
    first = first[sa]
    fresh = np.concatenate(([True], first[1:] != first[:-1])) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[sa] = begin
    place, ahead = _unsorted(np.arange(n), begin), 8
    while len(place):
        suffix = sa[place]
        there = suffix + ahead
        # a suffix that ends before is smaller, the shorter the smaller
        second = np.where(there < n, rank[np.minimum(there, n - 1)], n - 1 - there) + n
        both = rank[suffix] * (2 * n) + second
        order = np.argsort(both)
        suffix, both = suffix[order], both[order]
        sa[place] = suffix
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        begin = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
        rank[suffix] = begin
        place, ahead = _unsorted(place, begin), 2 * ahead
    return sa, rank


def _unsorted(place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of groups with more than one member."""
    same = np.zeros(len(place) + 1, bool)
    same[1:-1] = begin[1:] == begin[:-1]
    return place[same[:-1] | same[1:]]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order (0 for the first).  By
    Kasai's recurrence a suffix has one byte less in common than the suffix that
    begins a byte earlier, where the bytes before the two agree; the others are compared."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (data[:-1] == data[before[1:] - 1])
    own = np.flatnonzero(~carried)
    shared = np.zeros(len(own), np.int64)
    eight = words(data, "<u8")
    open_ = np.flatnonzero(before[own] >= 0)
    while len(open_):
        a, b = own[open_] + shared[open_], before[own[open_]] + shared[open_]
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        differs = eight[a] ^ eight[b]
        low = (differs & (~differs + U(1))).astype(np.float64)  # the lowest bit that differs
        shared[open_] += np.where(differs == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        open_ = open_[differs == 0]
    shared = np.minimum(shared, n - np.maximum(own, before[own]))
    shared[before[own] < 0] = 0
    nth = np.cumsum(~carried) - 1
    return (shared[nth] - (np.arange(n) - own[nth]))[sa]


class Shard:
    """Spellings (key, digest, count, bytes) and which of their windows are repeated."""

    def __init__(self, spellings: list[tuple[int, bytes, int, bytes]], length: int) -> None:
        self.spellings, self.length = spellings, length
        sizes = np.array([len(s[3]) for s in spellings])
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(b"".join(s[3] for s in spellings), np.uint8)
        inside = np.arange(len(self.data)) - np.repeat(self.begin[:-1], sizes)
        window = inside <= np.repeat(sizes, sizes) - length
        many = np.repeat(np.array([s[2] > 1 for s in spellings]), sizes)
        self.sa, _ = suffix_array(self.data)
        run = np.cumsum(common_prefixes(self.data, self.sa) < length) - 1
        counted = window[self.sa]
        weight = np.bincount(run, counted * (1.0 + many[self.sa]), minlength=1)
        self.repeated = np.zeros(len(self.data), bool)
        self.repeated[self.sa] = counted & (weight[run] > 1)
        self.window = window

    def last_group(self) -> int:
        """The first spelling of the last key."""
        k = len(self.spellings) - 1
        while k and self.spellings[k - 1][0] == self.spellings[-1][0]:
            k -= 1
        return k

    def sorted_windows(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and bytes of the windows of some spellings, in the array's order."""
        here = (self.sa >= self.begin[first]) & (self.sa < self.begin[stop])
        place = self.sa[here]
        place = place[self.window[place]]
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[place]
        return place, np.ascontiguousarray(rows).view(f"S{self.length}").ravel()

    def spans(self, k: int) -> list[int]:
        """Bounds of the repeated windows of a spelling, one pair after another."""
        mask = self.repeated[self.begin[k] : self.begin[k + 1]].view(np.int8)
        return np.flatnonzero(np.diff(mask, prepend=0, append=0)).tolist()


def merge(one: Shard, theirs: tuple[np.ndarray, np.ndarray], other: Shard, ours: tuple[np.ndarray, np.ndarray]) -> None:
    """Mark the windows that two shards share: each side's are searched in the other's order."""
    for (shard, (place, rows)), (_, found) in (((one, theirs), ours), ((other, ours), theirs)):
        if len(found) and len(rows):
            at = np.searchsorted(found, rows).clip(max=len(found) - 1)
            shard.repeated[place[found[at] == rows]] = True


def repeated_spans(spellings: Iterator[tuple[int, bytes, int, bytes]], length: int, shard_bytes: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """(key, digest, spans) of spellings given by key."""
    held: list[tuple[Shard, int, tuple[np.ndarray, np.ndarray]]] = []  # earlier shards of a key that goes on

    def closed() -> Iterator[tuple[int, bytes, list[int]]]:
        for shard, first, _ in held:
            yield from ((*shard.spellings[k][:2], shard.spans(k)) for k in range(first, len(shard.spellings)))
        held.clear()

    def finish(batch: list, following: int | None) -> Iterator[tuple[int, bytes, list[int]]]:
        shard, stop = Shard(batch, length), len(batch)
        if held and held[0][0].spellings[-1][0] == batch[0][0]:
            stop = next((k for k in range(stop) if batch[k][0] != batch[0][0]), stop)
            ours = shard.sorted_windows(0, stop)
            for other, _, theirs in held:
                merge(other, theirs, shard, ours)
            if stop == len(batch) and following == batch[0][0]:
                held.append((shard, 0, ours))
                return
        yield from closed()
        first = shard.last_group() if following == batch[-1][0] else len(batch)
        yield from ((*batch[k][:2], shard.spans(k)) for k in range(first))
        if first < len(batch):
            held.append((shard, first, shard.sorted_windows(first, len(batch))))

    batch, size = [], 0
    for group in _by_key(spellings, shard_bytes):
        key, alone, rows = group
        if alone:  # nothing to compare with but itself
            k, digest, count, body = rows[0]
            if count > 1:
                yield k, digest, [0, len(body) - length + 1]
            elif len(body) > length:
                yield k, digest, Shard(rows, length).spans(0)
            continue
        for row in rows:
            if size >= shard_bytes:
                yield from finish(batch, row[0])
                batch, size = [], 0
            batch.append(row)
            size += len(row[3])
    if batch:
        yield from finish(batch, None)
    yield from closed()


def _by_key(spellings: Iterator[tuple[int, bytes, int, bytes]], most: int) -> Iterator[tuple[int, bool, list]]:
    """Parts of keys of about ``most`` bytes, and whether the part is a key's only spelling."""
    rows, size, opened = [], 0, False
    for row in spellings:
        if rows and (rows[0][0] != row[0] or size >= most):
            goes_on = rows[0][0] == row[0]
            yield rows[0][0], len(rows) == 1 and not opened and not goes_on, rows
            opened, rows, size = goes_on, [], 0
        rows.append(row)
        size += len(row[3])
    if rows:
        yield rows[0][0], len(rows) == 1 and not opened, rows


def _bodies(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer() or b"", np.uint8)


def _run_keys(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for data in _bodies(batch.column(2)):
                named, _, _, more = runs(data, length, gram)
                keys.append(np.concatenate((named, named[more])))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["t", "id", "keys"])

    return run


def _cuttings(length: int, gram: int):
    names = ["h", "c", "t", "start", "body"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for mark, wanted, data in zip(batch.column(0).to_pylist(), batch.column(1), _bodies(batch.column(2))):
                whole = data.tobytes()
                keys, begins, sizes, _ = runs(data, length, gram)
                for k in np.flatnonzero(np.isin(keys, wanted.values.to_numpy())).tolist():
                    start = int(begins[k])
                    body = whole[start : start + int(sizes[k]) + length - 1]
                    rows.append((int(keys[k]), hashlib.blake2b(body, digest_size=16).digest(), mark, start, body))
                    size += len(body)
                    if size > HAND_ON:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return run, "h long, c binary, t binary, start long, body binary"


def _shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        found = []

        def made() -> pa.RecordBatch:
            h, c, spans = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["h", "c", "spans"])

        for row in repeated_spans(rows, length, shard_bytes):
            if row[2]:
                found.append(row)
                if len(found) == 10_000:
                    yield made()
                    found.clear()
        if found:
            yield made()

    return run, "h long, c binary, spans array<long>"


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(_bodies(batch.column(3))):
                one, two = (gram_hashes(data, length, seed).view(np.int64) for seed in (0, 1))
                n = len(one)
                same = [pa.repeat(batch.column(i)[k], n) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *same, pa.array(np.arange(n))], ["w1", "w2", "h", "c", "copies", "at"])

    return run, "w1 long, w2 long, h long, c binary, copies long, at long"


def _of_hot_keys(hot: DataFrame, length: int) -> DataFrame:
    """(h, c, spans) of spellings whose key has too many: every window is a row with
    a 128-bit hash, and those that occur again are counted and joined in Spark."""
    run, schema = _window_rows(length)
    rows = materialize(hot.select("h", "c", "copies", "body").mapInArrow(run, schema))
    often = rows.groupBy("w1", "w2").agg(F.sum(F.least("copies", F.lit(2))).alias("n")).where("n > 1").select("w1", "w2")
    marked = rows.join(often, ["w1", "w2"]).groupBy("h", "c").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return marked.select("h", "c", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("spans"))


def _cut(length: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, count, kept, bounds = [], [], [], [], []
            for pairs, copies, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _bodies(batch.column(3))):
                n = len(data)
                if (copies or 0) > 1 and n >= length:
                    pairs = [0, n - length + 1]
                edge = np.zeros(n + 1, np.int32)
                windows = np.array(pairs or [], np.int64).reshape(-1, 2)
                np.add.at(edge, windows[:, 0], 1)
                np.add.at(edge, windows[:, 1] + length - 1, -1)
                covered = np.cumsum(edge[:n]) > 0
                change = np.flatnonzero(np.diff(covered.view(np.int8), prepend=0, append=0))
                sizes.append(n)
                gone.append(int(covered.sum()))
                count.append(len(change) // 2)
                kept.append(data[~covered].tobytes())
                bounds.append(change.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(bounds, pa.list_(pa.int64()))],
                [key, "n_bytes", "n_removed", "n_spans", "kept", "bounds"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary, bounds array<long>) of every
    document: what is left of it, and the start and end of each removed span."""
    if length < 16:
        raise ValueError("windows of 16 bytes at least")
    gram = max(8, 6 * length // 25)
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    every = docs.select(F.col(key).alias("id"), body.alias("body"))
    mark = F.unhex(F.substring(F.sha2("body", 256), 1, 32))
    long_enough = every.where(F.octet_length("body") >= length).withColumn("t", mark)
    keyed = long_enough.select("t", "id", "body").mapInArrow(_run_keys(length, gram), f"t binary, id {kind}, keys array<long>")
    classes = materialize(keyed.groupBy("t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")))

    # where a short hash of two texts is equal, both only get more keys than they need
    short = F.xxhash64("t").alias("s")
    places = classes.select(short, "id", F.explode("keys").alias("h"))
    again = places.groupBy("h").count().where("count > 1").select("h")
    wanted = places.join(again, "h").groupBy("s", "id").agg(F.collect_set("h").alias("wanted"))
    theirs = long_enough.withColumn("s", short).join(wanted.withColumnRenamed("id", "first_id"), "s").where(F.col("id").eqNullSafe(F.col("first_id")))
    run, schema = _cuttings(length, gram)
    cuttings = materialize(theirs.select("t", "wanted", "body").mapInArrow(run, schema))
    spelled = materialize(cuttings.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.first("body").alias("body")))

    large = materialize(spelled.groupBy("h").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > group_bytes).select("h"))
    run, schema = _shards(length, shard_bytes)
    usual = spelled.join(large, "h", "left_anti").select("h", "c", "copies", "body")
    spans = usual.repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, schema)
    found = materialize(spans.unionByName(_of_hot_keys(spelled.join(large, "h", "left_semi"), length)))

    placed = cuttings.select("h", "c", "t", "start").join(found, ["h", "c"])
    by_text = placed.groupBy("t").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("start")))).alias("pairs"))
    verdicts = materialize(classes.select("t", "copies").join(by_text, "t", "left").where("copies > 1 or pairs is not null"))
    discard(classes, cuttings, spelled, large, found)
    result = every.withColumn("t", mark).join(verdicts, "t", "left").select("id", "pairs", "copies", "body")
    return result.mapInArrow(_cut(length, key), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, bounds array<long>")
