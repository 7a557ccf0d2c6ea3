"""Merkle fixity audit of web-archive replicas.

Records are grouped in archive files and ordered by offset.  A record's leaf is
the SHA-256 of its bytes; a node is the SHA-256 of up to ``FAN`` consecutive
children and of the ranges that they cover, as offsets from the node's own
start; the single node on top is the file's root.  So a record that changes its
size changes the nodes above it and no others.  Replicas of a file are compared
root by root, and only nodes under a differing node are looked at on the level
below.  Under the last differing branches the records are aligned by their id,
the how-many-th of that id and their digest, since a missing record moves all
later ones of its file; so each altered, missing or surplus record is named, and
no other.

Every node has at most ``FAN`` children and is made by an aggregation over
(file, node number); levels are written to the shared folder and deleted when the
audit is done.  A record's place is the sum of three: the records before its id and
the beginning of its digest in the file (a row for each of those is ordered, 256 an id
at most), those before its digest there, and its own number among equal ones.  So an id
that is a large part of all records is never ordered in one task, and equal records
are counted before they are shuffled.

Null payloads count as empty.  Repeated rows are records of their own, next to
each other; files in only one replica are reported with all their records.
Records with a null id are dealt over ``NULL_FILES`` files by their address and
aligned by digest.  An empty table gives an empty tree and an empty report.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import discard, materialize

FAN = 16
RECORDS_PER_FILE = 512
#: Hexadecimal digits of a digest that part the records of an id.
PREFIX = 2
#: Files (with negative numbers) for records without an id.
NULL_FILES = 1024


def response_record(uri: Column, record_id: Column, payload: Column) -> Column:
    """A WARC/1.0 response record as text; its Content-Length counts bytes of UTF-8."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """``pages`` (page_id, url, html) -> a row per record in archive order:
    (warc, place long, page_id, start long, stop long, digest)."""
    record = response_record(F.col("url"), F.col("page_id"), F.col("html"))
    hashed = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url"), F.lit(NULL_FILES))).cast("long").alias("warc"),
        F.col("page_id").cast("long").alias("page_id"),
        F.octet_length(record).cast("long").alias("size"),
        F.sha2(record, 256).alias("digest"),
    )
    equal = materialize(hashed.groupBy("warc", "page_id", "digest", "size").agg(F.count("*").alias("copies")).withColumn("part", F.left("digest", F.lit(PREFIX))))
    bytes_of = F.col("copies") * F.col("size")
    parts = equal.groupBy("warc", F.col("page_id").alias("_page"), F.col("part").alias("_part")).agg(F.sum("copies").alias("_n"), F.sum(bytes_of).alias("_b"))
    before = Window.partitionBy("warc").orderBy(F.col("_page").asc_nulls_first(), "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("warc").alias("_warc"), "_page", "_part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("_n", "_b")))
    within = Window.partitionBy("warc", "page_id", "part").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = equal.withColumn("_n1", F.coalesce(F.sum("copies").over(within), F.lit(0))).withColumn("_b1", F.coalesce(F.sum(bytes_of).over(within), F.lit(0)))
    met = own.join(starts, (F.col("warc") == F.col("_warc")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("part") == F.col("_part")))
    each = met.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("_b0") + F.col("_b1") + F.col("_i") * F.col("size")
    return each.select("warc", (F.col("_n0") + F.col("_n1") + F.col("_i")).cast("long").alias("place"), "page_id", start.cast("long").alias("start"), (start + F.col("size")).cast("long").alias("stop"), "digest")


LEVEL = ["warc", "place", "start", "stop", "digest"]


def _above(nodes: DataFrame, fan: int) -> DataFrame:
    child = F.sort_array(F.collect_list(F.struct("place", "start", "stop", "digest")))
    grouped = nodes.groupBy("warc", F.floor(F.col("place") / fan).cast("long").alias("place")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), child.alias("c"))
    ranges = F.transform("c", lambda c: F.concat_ws(":", c["start"] - F.col("start"), c["stop"] - F.col("start"), c["digest"]))
    return grouped.select("warc", "place", "start", "stop", F.sha2(F.array_join(ranges, "|"), 256).alias("digest"))


def merkle_tree(records: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels from the leaves up, each (warc, place, start, stop, digest); the last
    has one node a file.  Files of less height repeat their root on top."""
    levels = [records]
    most = records.agg(F.max("place")).first()[0] or 0
    while most > 0:
        levels.append(materialize(_above(levels[-1].select(*LEVEL), fan)))
        most //= fan
    return levels


def audit(primary: DataFrame, replica: DataFrame, fan: int = FAN) -> DataFrame:
    """The differing records of two replicas' ``leaves``: (warc, place, page_id, start, stop,
    expected, found, damage); damage is altered, missing or surplus.  Place, start and stop are
    the primary's, for a surplus record the replica's."""
    left, right = materialize(primary), materialize(replica)
    ours, theirs = merkle_tree(left, fan), merkle_tree(right, fan)
    for short, long in ((ours, theirs), (theirs, ours)):
        while len(short) < len(long):
            short.append(materialize(_above(short[-1].select(*LEVEL), fan)))
    bad, seen = None, []
    for a, b in reversed(list(zip(ours[1:], theirs[1:]))):
        both = _under(bad, a, fan).select("warc", "place", F.col("digest").alias("expected")).join(_under(bad, b, fan).select("warc", "place", F.col("digest").alias("found")), ["warc", "place"], "full")
        bad = materialize(both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("warc", "place"))
        seen.append(bad)
    out = materialize(_aligned(_under(bad, left, fan), _under(bad, right, fan)))
    discard(left, right, *ours[1:], *theirs[1:], *seen)
    return out


def _aligned(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records of either side that the other lacks, paired by id where both have one left."""
    same = ["warc", "page_id", "digest"]
    counted = Window.partitionBy(*same).orderBy("place")

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(*same, F.row_number().over(counted).alias("copy"), F.struct("place", "start", "stop", "digest").alias(side))

    a, b = numbered(ours, "a"), numbered(theirs, "b").withColumnRenamed("digest", "digest_b")
    equal = a["warc"].eqNullSafe(b["warc"]) & a["page_id"].eqNullSafe(b["page_id"]) & (a["digest"] == b["digest_b"]) & (a["copy"] == b["copy"])
    keys = ["warc", "page_id"]
    apart = a.join(b, equal, "full").where(F.col("a").isNull() | F.col("b").isNull())
    apart = apart.select(*(F.coalesce(a[k], b[k]).alias(k) for k in keys), "a", "b")
    # of one id, the first record left here goes with the first left there
    order = Window.partitionBy(*keys, F.col("a").isNull()).orderBy(F.coalesce("a.place", "b.place"))
    nth = F.when(F.col("page_id").isNotNull(), F.row_number().over(order)).otherwise(F.row_number().over(order) * F.when(F.col("a").isNull(), -1).otherwise(1))
    paired = apart.withColumn("nth", nth).groupBy(*keys, "nth").agg(F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    damage = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "surplus").otherwise("altered")
    known = F.coalesce("a", "b")
    return paired.select(
        "warc", known["place"].alias("place"), "page_id", known["start"].alias("start"), known["stop"].alias("stop"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"), damage.alias("damage")
    )


def _under(bad: DataFrame | None, level: DataFrame, fan: int) -> DataFrame:
    """The nodes of ``level`` whose parents differ."""
    if bad is None:
        return level
    parents = bad.select("warc", F.col("place").alias("_parent"))
    return level.withColumn("_parent", F.floor(F.col("place") / fan).cast("long")).join(parents, ["warc", "_parent"], "left_semi").drop("_parent")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known faults, by page_id: every 97th page has a letter changed
    (or one appended where it is empty), every 389th is cut in half."""
    html = F.coalesce("html", F.lit(""))
    flipped = F.when(F.length(html) > 0, F.concat(F.when(F.left(html, F.lit(1)) == "x", "y").otherwise("x"), F.substring(html, F.lit(2), F.length(html)))).otherwise("x")
    halved = F.left(html, F.floor(F.length(html) / 2).cast("int"))
    changed = F.when(F.col("page_id") % 97 == 13, flipped).when(F.col("page_id") % 389 == 7, halved).otherwise(F.col("html"))
    return pages.withColumn("html", changed)
