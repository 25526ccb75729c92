"""A package of documents as a whole: what each document gives, the items to review, and the package's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.operators import approvals, documents, tables
from trestle.sources.scratch import cut

REVIEW = ("doc", "item", "place", "reason")


def analyze_pages(pages: DataFrame, kinds=None, signals=None) -> dict[str, DataFrame]:
    """What page documents (doc, page, text) give: documents (doc, kind, confidence, conflict), materials and approvals."""
    told = documents.classify_documents(pages, **({"kinds": kinds, "cover": None} if kinds else {}))
    whole = pages.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("text"))
    signs = documents.classify_signals(whole, "doc", "text", **({"signals": signals} if signals else {}))
    fused = documents.fuse_kinds(F.col("signal_kind"), F.col("signal_confidence"), F.col("kind"), F.col("confidence"), **({"kinds": {k: k for k in kinds}} if kinds else {}))
    both = told.join(signs.select("doc", "signal_kind", "signal_confidence"), "doc")
    found = approvals.extract_approvals(pages)
    told = cut(both.select("doc", *[c.alias(n) for n, c in fused.items()]), "documents")
    return {"documents": told, "materials": documents.extract_materials(pages), "approvals": cut(approvals.group_approvals(found), "groups")}


def classify_books(cells: DataFrame, signals=None) -> DataFrame:
    """doc, kind, confidence and conflict of every workbook: what its sheets are, against the signals of its file name and text."""
    sheets = tables.classify_tables(cells)
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    structure = sheets.groupBy("doc").agg(tables.structure_kind(F.collect_set("kind")).alias("structure"), F.max_by("confidence", rank).alias("structure_confidence"))  # a sheet has one of five kinds
    text = tables.table_text(cells).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "text"))), lambda x: x["text"]), " ").alias("text"))  # the first rows of each sheet
    signs = documents.classify_signals(text, "doc", "text", **({"signals": signals} if signals else {}))
    fused = documents.fuse_table_kinds(F.col("signal_kind"), F.col("signal_confidence"), F.col("strong_file"), F.col("structure"), F.col("structure_confidence"))
    return structure.join(signs, "doc").select("doc", *[c.alias(n) for n, c in fused.items()])


def analyze_books(cells: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """What workbooks (doc, sheet, row_idx, col_idx, value) give: documents (doc, kind), rows, and rows by what they become."""
    rows = cut(tables.analyze_sheets(cells, tables.known_family(), limit), "rows")  # read by every list and count that is made of them
    sheets = tables.classify_tables(cells)
    books = sheets.groupBy("doc").agg(tables.structure_kind(F.collect_set("kind")).alias("kind"))
    return {"documents": books, "rows": rows} | tables.split_by_type(rows)


def review_items(books: dict[str, DataFrame], pages: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per item to look at: doc, item (schedule, kind, approval or uncertain), place and reason."""
    rows = books["rows"]
    late = rows.where(F.size("review") > 0).select("doc", F.lit("schedule").alias("item"), F.col("row_idx").cast("string").alias("place"), F.array_join("review", ",").alias("reason"))
    vague = rows.where("row_type = 'uncertain'").groupBy("doc").agg(F.count("*").alias("n")).select("doc", F.lit("uncertain").alias("item"), F.lit("").alias("place"), F.col("n").cast("string").alias("reason"))
    out = late.unionByName(vague)
    if pages is not None:
        unsure = pages["documents"].where("confidence <> 'high' or conflict").select("doc", F.lit("kind").alias("item"), F.lit("").alias("place"), "kind", F.when(F.col("conflict"), "conflict").otherwise(F.col("confidence")).alias("reason")).drop("kind")
        asked = pages["approvals"].select("doc", F.lit("approval").alias("item"), F.col("page").cast("string").alias("place"), F.col("type").alias("reason"))
        out = out.unionByName(unsure.select(*REVIEW)).unionByName(asked.select(*REVIEW))
    return out.select(*REVIEW)


def package_summary(books: dict[str, DataFrame], pages: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row: documents, works, materials, machinery, commercial (documents), approvals and to_review."""
    kinds, items = books["documents"].select("doc", "kind"), [("works", books["works"]), ("materials", books["materials"]), ("machinery", books["machinery"]), ("to_review", review_items(books, pages))]
    if pages is not None:
        kinds = kinds.unionByName(pages["documents"].select("doc", "kind"))
        items += [("materials", pages["materials"]), ("approvals", pages["approvals"])]
    told = [kinds.select(F.lit("documents").alias("what")), kinds.where("kind in ('commercial-proposal', 'estimate')").select(F.lit("commercial").alias("what")), *(x.select(F.lit(n).alias("what")) for n, x in items)]
    every = told[0]
    for x in told[1:]:
        every = every.unionByName(x)
    names = ("documents", "works", "materials", "machinery", "commercial", "approvals", "to_review")
    return every.agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
