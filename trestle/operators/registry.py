"""Document register: content dedup, revisions, promotion and the effective revision.

A revision row has document, revision, content hash, status, received (timestamp). One revision of a document can be current.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions.parse import mapping
from trestle.functions.lexicon import FILE_NAME_KINDS, REGISTRY_KIND

IN_REVIEW = ("received", "under-review")


def first_of_content(rows: DataFrame, hash_col: str = "sha256", order: str = "doc_id") -> DataFrame:
    """The first row of each content: later ones are duplicates, whatever document they are for."""
    first = rows.groupBy(hash_col).agg(F.min(order).alias("first_id"), F.count("*").alias("copies"))
    return first.select(F.col("first_id").alias(order), hash_col, "copies")


def reject_known(arrivals: DataFrame, register: DataFrame, hash_col: str = "sha256") -> DataFrame:
    """Arrivals whose content the register does not have."""
    return arrivals.join(register.select(hash_col), hash_col, "left_anti")


def label_revisions(rows: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Adds revision_no, revision_label (R1, R2, ...) and previous_label."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    out = rows.withColumn("revision_no", n).withColumn("revision_label", F.concat(F.lit("R"), F.col("revision_no").cast("string")))
    return out.withColumn("previous_label", F.when(F.col("revision_no") > 1, F.concat(F.lit("R"), (F.col("revision_no") - 1).cast("string"))))


def register(arrivals: DataFrame, revisions: DataFrame) -> DataFrame:
    """Arriving files with what becomes of them: error, or document, revision_no, revision_label, previous_revision and status 'received'.

    arrivals: seq, document (null for a new one), title, label and sha256. revisions: document, revision, status and sha256.
    A title or a document is required, and a file; content that the register has, or an earlier arrival with the same, is
    refused whatever its document. A revision follows the document's current one; its label is R and its number if none is given.
    """
    titled = F.trim(F.coalesce("title", F.lit("")))
    known = revisions.select("sha256").where("sha256 is not null").distinct().withColumn("known_", F.lit(True))
    told = arrivals.join(known, "sha256", "left")
    wrong = F.when(F.col("document").isNull() & (titled == ""), "TITLE_REQUIRED").when(F.col("sha256").isNull(), "FILE_REQUIRED").when(F.col("known_"), "DUPLICATE_CONTENT")
    told = told.withColumn("error", wrong)
    firsts = told.where("error is null").groupBy("sha256").agg(F.min("seq").alias("first_"))
    told = told.join(firsts, "sha256", "left").withColumn("error", F.coalesce("error", F.when(F.col("seq") > F.col("first_"), "DUPLICATE_CONTENT")))
    target = F.coalesce(F.col("document").cast("string"), F.concat(F.lit("new:"), F.lower(titled)))
    told = told.withColumn("document", F.when(F.col("error").isNull(), target))
    held = revisions.groupBy(F.col("document").cast("string").alias("document")).agg(F.count("*").alias("held_"), F.max(F.when(F.col("status") == "current", F.col("revision"))).alias("previous_revision"))
    numbered = told.where("error is null").withColumn("nth_", F.row_number().over(Window.partitionBy("document").orderBy("seq"))).join(held, "document", "left")
    no = F.coalesce("held_", F.lit(0)) + F.col("nth_")
    label = F.coalesce(F.when(F.trim("label") != "", F.trim("label")), F.concat(F.lit("R"), no.cast("string")))
    taken = numbered.select("seq", "error", "document", no.alias("revision_no"), label.alias("revision_label"), "previous_revision", F.lit("received").alias("status"))
    refused = told.where("error is not null").select("seq", "error", "document")  # needs no number, so it meets no window
    return taken.unionByName(refused, allowMissingColumns=True)


def promote(rows: DataFrame, document: str, approved: Column, order: list[str]) -> DataFrame:
    """Adds status: of a document's approved revisions the latest is current and the earlier ones superseded; others keep received."""
    w = Window.partitionBy(document, "approved_").orderBy(*[F.col(c).desc() for c in order])
    out = rows.withColumn("approved_", approved).withColumn("place_", F.row_number().over(w))
    status = F.when(F.col("approved_") & (F.col("place_") == 1), "current").when(F.col("approved_"), "superseded").otherwise("received")
    return out.withColumn("status", status).drop("approved_", "place_")


def effective(rows: DataFrame, document: str, received: str, tie: str) -> DataFrame:
    """The current revision of each document, or else the one received last: one aggregate."""
    key = F.struct((F.col("status") == "current").alias("is_current"), F.col(received), F.col(tie))
    best = rows.groupBy(document).agg(F.max_by(F.struct(*rows.columns), key).alias("r"))
    return best.select("r.*")


def counters(rows: DataFrame, document: str) -> DataFrame:
    """One row: documents, revisions, current, in_review."""
    return rows.agg(
        F.countDistinct(document).alias("documents"), F.count("*").alias("revisions"), F.count_if(F.col("status") == "current").alias("current"), F.count_if(F.col("status").isin(*IN_REVIEW)).alias("in_review")
    )


def overview(rows: DataFrame, document: str, by: str) -> DataFrame:
    """Distinct documents, revisions, current ones and those in review by a column, and over all rows (whole is true), in one pass with grouping sets."""
    sums = rows.groupingSets([[by], []], by).agg(
        (F.grouping_id() > 0).alias("whole"), F.countDistinct(document).alias("documents"), F.count("*").alias("revisions"),
        F.count_if(F.col("status") == "current").alias("current"), F.count_if(F.col("status").isin(*IN_REVIEW)).alias("in_review"),
    )
    return sums.select(by, "whole", "documents", "revisions", "current", "in_review")


def guess_kind(name: Column, classified: Column, patterns: Sequence[tuple[str, str]] = tuple(FILE_NAME_KINDS)) -> Column:
    """Kind of an upload from its classification, else by the first pattern (words, then extension) that its file name has."""
    n = F.lower(F.coalesce(name, F.lit("")))
    by_name = F.lit("other")
    for pattern, kind in reversed(patterns):
        by_name = F.when(F.regexp_like(n, F.lit(pattern)), kind).otherwise(by_name)
    return F.coalesce(mapping(REGISTRY_KIND)[classified], by_name)
