"""The engine's stores: JSON tables with defaults, and their changes as events.

A record that does not parse is kept in ``_corrupt`` and told apart by broken(), never dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

CONTEXT = "id string, project string, object string, work string, start date, end date, safety_days string, ord bigint"
PROJECT = "id string, parent_id string, node_type string, name string, object string, code string, contract_number string, status string, created_at timestamp, updated_at timestamp"
REVISION = "document string, title string, kind string, revision string, revision_label string, previous_revision string, project_ids array<string>, file_name string, bytes bigint, sha256 string, received timestamp, status string"
REVIEW = "document string, page int, name string, review_status string, reviewed_at timestamp"
EVENT = "id string, material_id string, material_name string, action string, occurred_at timestamp, reason string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def broken(rows: DataFrame) -> DataFrame:
    """The records of a loaded store that did not parse."""
    return rows.where("_corrupt is not null")


def sound(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt is null").drop("_corrupt")


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Work contexts: safety days that are no number count as 0, a missing end is the start."""
    days = F.coalesce(F.expr("try_cast(safety_days as double)"), F.lit(0.0)).cast("int")
    return _read(spark, path, CONTEXT).withColumn("safety_days", days).withColumn("end", F.coalesce("end", "start"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project nodes: a missing type is root without a parent and linked with one, a missing status is active."""
    rows = _read(spark, path, PROJECT)
    return rows.withColumn("node_type", F.coalesce("node_type", F.when(F.col("parent_id").isNull(), "root").otherwise("linked"))).withColumn("status", F.coalesce("status", F.lit("active")))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Document revisions: a missing status is received, missing projects are none."""
    rows = _read(spark, path, REVISION)
    return rows.withColumn("status", F.coalesce("status", F.lit("received"))).withColumn("project_ids", F.coalesce("project_ids", F.array().cast("array<string>")))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of material candidates: a missing status is pending."""
    return _read(spark, path, REVIEW).withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Events of the material history, or of an archive."""
    return _read(spark, path, EVENT)


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """Rows as they are saved: created once, updated each time."""
    return rows.withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now)


#: Ids that an event holds, about.
EVENT_IDS = 1000


def change_events(changes: DataFrame, key: str, action: str, at: str, chunk_ids: int = EVENT_IDS) -> DataFrame:
    """Events for each action and moment, each with some of the distinct ids: action, at, chunk, ids (ascending), n (ids here) and total (ids of all chunks).

    An action over many ids becomes as many events as keep them to about ``chunk_ids`` each: ids are dealt out by their hash,
    so no row holds all ids of a moment, and one moment's ids are spread over tasks. For batches and, in foreachBatch, for streams.
    """
    ids = changes.select(F.col(action).alias("action"), F.col(at).alias("at"), F.col(key).alias("id")).distinct()
    counted = ids.groupBy("action", "at").agg(F.count("id").alias("total"))
    met = ids.join(counted.withColumnsRenamed({"action": "a_", "at": "t_"}), F.col("action").eqNullSafe(F.col("a_")) & F.col("at").eqNullSafe(F.col("t_")))
    dealt = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("total") / chunk_ids), F.lit(1))).cast("int"))
    return dealt.groupBy("action", "at", "chunk", "total").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("action", "at", "chunk", "ids", F.size("ids").alias("n"), "total")


def write_batch_once(events: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch under its number: a batch that comes again, as it may after a failure, replaces itself."""
    events.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_change_events(changes: DataFrame, path: str, checkpoint: str, key: str, action: str, at: str) -> DataStreamWriter:
    """A stream of changes to event rows, each micro-batch exactly once in ``path``; read_batches() gives them."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: write_batch_once(change_events(batch, key, action, at), batch_id, path))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def archive_all(materials: DataFrame, now: Column, reason: str = "reset") -> DataFrame:
    """Every active material archived at one moment, each with a revision more; archived ones stay as they are."""
    active = F.coalesce("status", F.lit("active")) == "active"
    keep = lambda name, new: F.when(active, new).otherwise(F.col(name) if name in materials.columns else F.lit(None)).alias(name)
    others = [c for c in materials.columns if c not in ("status", "revision", "archived_at", "archive_reason")]
    return materials.select(*others, keep("status", F.lit("archived")), keep("revision", F.coalesce("revision", F.lit(1)) + 1), keep("archived_at", now), keep("archive_reason", F.lit(reason)))
