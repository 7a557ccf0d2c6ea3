"""Parquet tables clustered by a column: ranges in files, sorted, in small row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a row group: small enough that a narrow range leaves most groups out by their bounds.
ROW_GROUP = 1 << 20


def clustered(rows: DataFrame, column: str, path: str, files: int | None = None, row_group: int = ROW_GROUP) -> DataFrame:
    """Write ``rows`` under ``path`` in ranges of ``column``, sorted within, and return the table.  A
    value that is very common is dealt over several files by the rest of the row; nulls are first."""
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in rows.columns if c != column]
    dealt = rows.withColumn("_deal", F.xxhash64(*rest) if rest else F.lit(0)).repartitionByRange(files, column, "_deal").sortWithinPartitions(column, "_deal").drop("_deal")
    dealt.write.option("parquet.block.size", row_group).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def files_of_range(table: DataFrame, column: str) -> DataFrame:
    """(file, first, last, n): the range that each file holds, for checks of the layout."""
    return table.groupBy(F.input_file_name().alias("file")).agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("n"))
