"""Project nodes, work contexts and keyed registers as set-based changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions.text import joined_label, normalize_key


def context_errors(project: Column, object_: Column, work: Column, start: Column, end: Column, safety_days: Column) -> Column:
    """The first rule that a context breaks, or null: labels and start are required, the end is not before the start, safety days are not negative."""
    missing = F.lit(False)
    for c in (project, object_, work):
        missing = missing | (normalize_key(c) == "")
    return F.when(missing | start.isNull(), "REQUIRED").when(end < start, "DATE_ORDER").when(safety_days < 0, "SAFETY_DAYS")


def add_contexts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New contexts with error: a broken rule, DUPLICATE if the register or an earlier new one has the same labels by key, or null if it is added."""
    keys = ["k_project", "k_object", "k_work"]
    keyed = lambda df: df.withColumns({f"k_{c}": normalize_key(c) for c in ("project", "object", "work")})
    known = keyed(existing).select(*keys).distinct().withColumn("known_", F.lit(True))
    out = keyed(new).withColumn("error", context_errors(*[F.col(c) for c in ("project", "object", "work", "start", "end", "safety_days")]))
    w = Window.partitionBy(*keys, F.col("error").isNull()).orderBy("ord")
    out = out.join(known, keys, "left").withColumn("place_", F.row_number().over(w))
    again = F.col("error").isNull() & (F.col("known_") | (F.col("place_") > 1))
    return out.withColumn("error", F.when(again, "DUPLICATE").otherwise(F.col("error"))).drop("known_", "place_", *keys)


def active_context(contexts: DataFrame, chosen: int | None) -> DataFrame:
    """The chosen context, or the first by ord if it is gone."""
    rank = F.when(F.col("ord") == chosen, 0).otherwise(1) if chosen is not None else F.lit(1)
    return contexts.orderBy(rank, "ord").limit(1)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Base rows with changes laid over them by key: the latest change wins. One aggregate over both."""
    values = [c for c in base.columns if c not in keys]
    rows = base.withColumn("at_", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.select(*base.columns, F.col(order).alias("at_")))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col("at_").isNotNull(), "at_")).alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def all_nodes(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """Root and linked project nodes, each with its label of code, name and object."""
    both = roots.unionByName(linked, allowMissingColumns=True)
    return both.withColumn("label", joined_label([F.col("code"), F.col("name"), F.col("object")]))


def add_linked(linked: DataFrame, new: DataFrame) -> DataFrame:
    """New linked nodes whose name and code the register does not have."""
    k = lambda df: df.withColumns({"k_name": normalize_key("name"), "k_code": normalize_key("code")})
    return k(new).join(k(linked).select("k_name", "k_code"), ["k_name", "k_code"], "left_anti").drop("k_name", "k_code")


def toggled(status: Column) -> Column:
    return F.when(status == "active", "closed").otherwise("active")


def node_projects(revisions: DataFrame, ids: str = "project_ids") -> DataFrame:
    """One row per revision and project of it."""
    return revisions.withColumn("project_id", F.explode(ids)).drop(ids)


def inherited_projects(revisions: DataFrame, document: str, order: str) -> DataFrame:
    """The project ids that a new revision of a document starts with: the current revision's, else the latest one's."""
    best = revisions.groupBy(document).agg(F.max_by("project_ids", F.struct(F.col("status") == "current", order)).alias("project_ids"))
    return best
