"""Search, facets and small views over a published profile index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(index: DataFrame, text: Column, query: str, equals: dict[str, str] | None = None) -> DataFrame:
    """Rows whose (normalised) text holds every word of the query and whose columns equal the filters."""
    words = [w for w in query.lower().split() if w]
    out = index
    if words:
        out = out.where(F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)))
    for column, value in (equals or {}).items():
        out = out.where(F.col(column) == value)
    return out


def facet_values(index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n): distinct known values of each column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return index.select(pairs).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def largest_shift(rows: DataFrame, key: Sequence[str], shift: str, label: str) -> DataFrame:
    """The label with the largest absolute shift of each key (ties: the first label)."""
    best = F.min_by(F.struct(F.col(label), F.col(shift)), F.struct(-F.abs(F.col(shift)), F.col(label)))
    return rows.where(F.col(shift).isNotNull()).groupBy(*key).agg(best.alias("_b")).select(*key, F.col(f"_b.{label}").alias(label), F.col(f"_b.{shift}").alias(shift))


def family_means(rows: DataFrame, key: Sequence[str], family: str, value: str) -> DataFrame:
    return rows.groupBy(*key, family).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def first_of(rows: DataFrame, items: str, n: int) -> DataFrame:
    """The first n entries of a published order."""
    return rows.withColumn(items, F.slice(items, 1, n))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (path, content) against a manifest (path, bytes, sha256): (path, status) ok,
    undeclared, missing, size or digest."""
    joined = files.select("path", F.octet_length("content").alias("_bytes"), F.sha2("content", 256).alias("_sha")).join(manifest, "path", "full")
    status = F.when(F.col("sha256").isNull(), "undeclared").when(F.col("_sha").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "digest")
    return joined.select("path", status.otherwise("ok").alias("status"))
