"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the
    context's checkpoint folder.  Only where neither is set and everything runs
    on one machine (tests) a temporary folder is made and set; a cluster without
    one is refused, since its executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage
    is cut, and lost executors cost a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanmill_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_spanmill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts in an Arrow batch.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Texts are long, so the session's Arrow batches get ``BATCH_ROWS`` rows at most, which
    bounds what executors and their workers hold; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (id long, component long), the smallest id
    reachable.  Each round takes the smallest label among neighbours and then
    the label of that label, so paths shorten geometrically; each round's
    labels are written to the shared folder.  Null ends and loops are ignored.

    A hub's edges are aggregated partially before they are shuffled, and joins
    on a hub or a shared label have one side from a written table, so adaptive
    execution splits what is skewed there.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = materialize(
            hooked.join(roots, "label", "left").select("id", F.least("label", "root").alias("label"), (F.least("label", "root") != F.col("old")).alias("moved"))
        )
        moved = jumped.where("moved").limit(1).count()
        discard(labels)
        labels = jumped
        if not moved:
            discard(both)
            out = labels.select("id", F.col("label").alias("component"))
            out._spanmill_path = labels._spanmill_path
            return out
