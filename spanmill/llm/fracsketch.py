"""Threshold-scaled document sketches, with Spark expressions only.

A document's sketch keeps every shingle hash below a fixed fraction of the hash
range.  The fraction is the same for all documents, so the sketch of a union
is the union of sketches, and what two sketches share estimates containment
even between very unequal documents.  The error of that estimate is about
sqrt(c * (1 - c) * one_in / n) for a containment c of n shingles.

A written fingerprint is the sketch and, after a hyphen, sixteen digits of the
text's SHA-256.  Equal texts have equal fingerprints and likeness 1.  A text
of few shingles may have none below the threshold: its sketch is empty, and it
is alike only with an equal text (likeness 0 with any other).

Shingles are runs of ``width`` words (split at white space, lower-cased); a
text of fewer words has its whole sequence as one, a null or blank text has
none and an empty sketch.  Rows are independent.  Input columns other than the
id and the text are ignored by ``compare_with_edit``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: A shingle hash is kept if it is below this share of the range.
ONE_IN = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sketch_of(word_list: Column, width: int = WIDTH, one_in: int = ONE_IN) -> Column:
    """array<int>, sorted and distinct: hashes of 31 bits below the threshold.
    ``word_list`` should be a column, since it is read several times."""
    n = F.size(word_list)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    # 31 bits of a 64-bit hash: a counter from 0
    hashes = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(word_list, i, F.lit(width))), 33).cast("int"))
    return F.array_distinct(F.array_sort(F.filter(hashes, lambda h: h < (1 << 31) // one_in)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has, 0 to 1; 0 where one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / small)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts together (of their shingles)."""
    return F.array_sort(F.array_union(a, b))


def mark(text: Column) -> Column:
    """What tells a text from others where sketches can't."""
    return F.left(F.sha2(text, 256), F.lit(16))


def written(sketch: Column, digest: Column, one_in: int = ONE_IN) -> Column:
    """A fingerprint as text: the hashes in order, each in as many hexadecimal digits as the
    threshold takes, a hyphen and the text's mark."""
    digits = len(f"{(1 << 31) // one_in - 1:X}")
    return F.concat(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), digits, "0")), ""), F.lit("-"), digest)


def with_sketch(docs: DataFrame, text: str = "text", to: str = "sketch", **options) -> DataFrame:
    listed = docs.withColumn("__words", words(F.coalesce(F.col(text), F.lit(""))))
    return listed.withColumn(to, sketch_of(F.col("__words"), **options)).drop("__words")


def with_next(rows: DataFrame, key: str, carried: list[str], per_partition: int = 2) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by key (ties:
    by the carried columns; a null key comes first), after the last the first.

    Rows are dealt by ranges of the key.  Each range also gets a copy of the
    first row of the range after it, so its last row finds its successor there;
    those are as many rows as there are ranges."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    keyed = rows.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")))
    cuts = keyed.select(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    spread = keyed.withColumn("_range", _range_of(F.col("_key"), cuts))
    firsts = {r["_range"]: r["low"] for r in spread.groupBy("_range").agg(F.min("_key").alias("low")).collect()}
    present = sorted(firsts)
    before = {firsts[r]: present[i - 1] for i, r in enumerate(present)}  # a row a range
    if before:
        moved = F.element_at(F.create_map(*(F.lit(x).cast(t) for low, r in before.items() for x, t in ((low, "long"), (r, "int")))), F.col("_key"))
        heads = spread.where(F.col("_key").isin(list(before))).withColumn("_range", moved).withColumn("_copy", F.lit(True))
        spread = spread.withColumn("_copy", F.lit(False)).unionByName(heads)
    else:
        spread = spread.withColumn("_copy", F.lit(False))
    order = ["_copy", "_key", *(F.col(c).asc_nulls_first() for c in carried)]
    window = Window.partitionBy("_range").orderBy(*order)
    placed = spread.withColumn("_next", F.lead(F.struct(*carried)).over(window)).where(~F.col("_copy"))
    return placed.select(*rows.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def _range_of(key: Column, cuts: list) -> Column:
    """How many cuts the key has reached: looked up among the first of about sqrt(n) runs, then within one run."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def listed(of: list) -> Column:
        return F.array(*(F.lit(c) for c in of))

    def reached(among: Column) -> Column:
        return F.size(F.filter(among, lambda c: c <= key))

    within = F.get(F.array(*map(listed, runs)), reached(listed([r[0] for r in runs])) - 1)
    return F.when(key < cuts[0], 0).otherwise((reached(listed([r[0] for r in runs])) - 1) * width + reached(within))


def compare_with_edit(docs: DataFrame, width: int = WIDTH, one_in: int = ONE_IN) -> DataFrame:
    """Fingerprints of every text and of its edit (the last quarter replaced by the head of the next document)."""
    options = {"width": width, "one_in": one_in}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, **options).withColumn("mark", mark(F.col("text"))), "doc_id", ["text", "sketch", "mark"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", **options).withColumn("edited_sha256", F.sha2("edited", 256))
    edited_mark = F.left("edited_sha256", F.lit(16))

    def likeness(sketch: str, other: Column) -> Column:
        return F.when(F.col("mark") == other, F.lit(1.0)).otherwise(containment(F.col("sketch"), F.col(sketch)))

    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "edited_sha256",
        written(F.col("sketch"), F.col("mark"), one_in).alias("fingerprint"),
        written(F.col("edited_sketch"), edited_mark, one_in).alias("edited_fingerprint"),
        likeness("edited_sketch", edited_mark).alias("near_edited"),
        likeness("next_sketch", F.col("next_mark")).alias("near_next"),
    )
