"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters that are neither space nor TAB..CR; bytes.split() without arguments splits on the same characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps A-Z to a-z in UTF-8 bytes and leaves all others.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="trestle-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/trestle-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors, keeps columns prunable.

    Once it is written, Spark drops the shuffle files that led to it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._trestle_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_trestle_path", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Prepare a session for tasks with texts: Arrow batches end by bytes, so long documents do not add up in a worker (a size that the session has set stays)."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in paths.split(":"):  # tasks find this package wherever the driver was started
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(x for x in (PACKAGE_ROOT, paths) if x)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def crc32_mod4(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, mod 4."""
    return F.crc32(doc_id.cast("string")) % 4
