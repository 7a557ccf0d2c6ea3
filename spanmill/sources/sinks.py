"""Sinks: Parquet with resumable chunks, manifests, canonical JSON, staged folders, archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import os
import shutil
import tarfile
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """zstd Parquet; the job's commit makes it appear whole or not at all."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_manifest_csv(rows: DataFrame, path: str) -> None:
    """A small table as one CSV file with header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def pending_replicates(spark: SparkSession, path: str, requested: int, rows_each: int) -> DataFrame:
    """Replicates from 0 to requested - 1 that a chunk folder (partitioned by ``replicate``) lacks.
    A replicate that is there with another number of rows is an error."""
    wanted = spark.range(requested).withColumnRenamed("id", "replicate")
    try:
        there = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return wanted
        raise
    counted = there.groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.count("*").alias("n"))
    whole = F.when(F.col("n") == rows_each, F.col("replicate")).otherwise(F.raise_error(F.lit("a replicate has another number of rows")).cast("long"))
    return wanted.join(counted.select(whole.alias("replicate")), "replicate", "left_anti")


def append_replicates(df: DataFrame, path: str) -> None:
    """Adds replicates to a chunked table; one that is there already is an error and nothing is written."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(F.col("replicate").cast("long").alias("replicate")).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        there = None
    if there is not None:
        again = df.select(F.col("replicate").cast("long").alias("replicate")).distinct().join(there, "replicate", "left_semi").orderBy("replicate").first()
        if again is not None:
            raise FileExistsError(f"replicate {again.replicate} is there already")
    df.write.mode("append").option("compression", "zstd").partitionBy("replicate").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, md5) of files, hashed on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verify_md5(spark: SparkSession, path: str, expected: Mapping[str, str]) -> list[str]:
    """Names of pinned files whose MD5 differs or that are missing."""
    found = {os.path.basename(r.path): r.md5 for r in file_digests(spark, path).collect()}
    return sorted(name for name, md5 in expected.items() if found.get(name) != md5)


def canonical_json(value: Any) -> bytes:
    """Sorted keys, no NaN or infinity, UTF-8, a newline at the end."""

    def check(x: Any) -> None:
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a number isn't finite")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(value)
    return (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()


def content_digest(files: Mapping[str, Any]) -> str:
    """SHA-256 over names and canonical contents in the order of names."""
    out = hashlib.sha256()
    for name in sorted(files):
        out.update(name.encode() + b"\0" + canonical_json(files[name]))
    return out.hexdigest()


def load_config(path: str | Path, required: list[str]) -> dict:
    """JSON settings without defaults: a missing key is an error."""
    config = json.loads(Path(path).read_text())
    missing = [k for k in required if k not in config]
    if missing:
        raise KeyError(f"settings lack {', '.join(missing)}")
    return config


def same_manifest(path: Path, expected: dict) -> None:
    """Write the manifest of a run, or insist that the one there is equal."""
    data = canonical_json(expected)
    if path.exists():
        if path.read_bytes() != data:
            raise ValueError("the folder belongs to a run with other settings")
    else:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def publish(files: Mapping[str, bytes], target: Path) -> None:
    """Write a folder beside the target, then swap; the old one comes back if the swap fails."""
    target.parent.mkdir(parents=True, exist_ok=True)
    staging = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    old = staging.with_name(staging.name + "-old")
    try:
        for name, data in files.items():
            (staging / name).parent.mkdir(parents=True, exist_ok=True)
            (staging / name).write_bytes(data)
        if target.exists():
            target.rename(old)
        try:
            staging.rename(target)
        except OSError:
            if old.exists():
                old.rename(target)
            raise
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def pack_archive(files: Mapping[str, bytes], path: Path, most_bytes: int | None = None) -> str:
    """A tar.gz that depends on the contents alone; returns its SHA-256."""
    raw = io.BytesIO()
    with gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as zipped, tarfile.open(fileobj=zipped, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(files[name]), 0, 0o644
            tar.addfile(info, io.BytesIO(files[name]))
    data = raw.getvalue()
    if most_bytes is not None and len(data) > most_bytes:
        raise ValueError(f"the archive has {len(data)} bytes; {most_bytes} are allowed")
    path.write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def unpack_archive(path: Path, sha256: str, members: Mapping[str, str]) -> dict[str, bytes]:
    """Contents of an archive whose own digest, members and member digests are as declared."""
    data = path.read_bytes()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the archive's digest differs")
    out = {}
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        for info in tar.getmembers():
            if not info.isfile() or info.name.startswith(("/", "..")) or "/../" in info.name:
                raise ValueError(f"the archive holds {info.name!r}")
            out[info.name] = tar.extractfile(info).read()
    if set(out) != set(members):
        raise ValueError("the archive's members differ")
    for name, digest in members.items():
        if hashlib.sha256(out[name]).hexdigest() != digest:
            raise ValueError(f"the digest of {name} differs")
    return out
