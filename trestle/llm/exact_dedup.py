"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A frequent-items (Misra-Gries) sketch over text digests names at most ``max_heavy`` candidates. Their groups are
counted exactly with map-side partial aggregates, and those that are truly frequent (the winners, a table whose size
has a fixed bound) are broadcast: rows of a frequent text are resolved where they stand and never shuffled. All other
digests go through an ordinary shuffle in which no group holds more than about one part in ``max_heavy`` of the rows:
groups are summed up before it, and rows meet their group in a join that may split a large one.

Defined cases: a null text counts as empty; a null id is below every other id; of rows that share the largest id of a
group exactly one stays; a very long text is hashed whole where it is read and goes no further; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm._common import ascii_lower, materialize

#: Candidates that the sketch may report, and the counters that it holds.
MAX_HEAVY, SKETCH_ITEMS = 256, 4096


def _groups(rows: DataFrame, *more: str) -> DataFrame:
    """digest, group_size and best (the row that stays), summed up where rows stand before they are shuffled."""
    return rows.groupBy("digest", *more).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("best"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes) and a row number that stays fixed once the table is written."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("row_id", F.monotonically_increasing_id())


def heavy_digests(rows: DataFrame, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The verified frequent digests: digest, group_size and best (the row that stays). At most max_heavy rows."""
    sketch = rows.agg(F.expr(f"approx_top_k(hex(digest), {max_heavy}, {SKETCH_ITEMS})").alias("top"), F.count("*").alias("total"))
    candidates = sketch.select(F.explode("top.item").alias("item"), "total").select(F.unhex("item").alias("digest"), "total")
    counted = _groups(rows.join(F.broadcast(candidates), "digest"), "total")
    return counted.where(F.col("group_size") > 1).where(F.col("group_size") >= F.col("total") / (4 * SKETCH_ITEMS)).drop("total")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256 of the text with A-Z lower-cased.

    Of equal texts the row with the largest id stays.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    heavy = materialize(heavy_digests(rows, max_heavy), "heavy")
    mapped = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return mapped.unionByName(rest.join(_groups(rest), "digest")).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast(T.LongType()).alias("group_size"),
        (F.col("best.row_id") == F.col("row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
