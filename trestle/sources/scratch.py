"""Tables between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="trestle-"))
    return f"{shared.rstrip('/')}/trestle-{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again: their lineage ends here, and a lost executor costs no earlier round."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
