"""Spreadsheet understanding: kind of a sheet, its header row, typed rows and their review.

Cells come long: doc, sheet, row_idx, col_idx, value (string), rows and columns from 0, blank rows taken out before.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.functions.parse import duration_days, parse_date, parse_number, table_unit
from trestle.functions.rows import once

#: Rows at the top of a sheet that tell its kind and hold its header, and days from which a schedule row is long.
SCAN_ROWS, LONG_DAYS = 40, 180
SHEET = ["doc", "sheet"]


def _head(cells: DataFrame, scan_rows: int | None) -> DataFrame:
    return cells if scan_rows is None else cells.where(F.col("row_idx") < scan_rows)


def table_text(cells: DataFrame, scan_rows: int | None = SCAN_ROWS) -> DataFrame:
    """doc, sheet, text (names of document and sheet and the first rows, normalised) and cells (their normalised values). scan_rows None: all rows."""
    head = _head(cells, scan_rows).withColumn("v", T.normalize_table("value"))
    filled = F.collect_list(F.when(F.col("v") != "", F.struct("row_idx", "col_idx", "v")))
    packed = head.groupBy(*SHEET).agg(F.transform(F.sort_array(filled), lambda x: x["v"]).alias("cells"))
    return packed.withColumn("text", T.normalize_table(F.concat_ws(" ", "doc", "sheet", F.array_join("cells", " "))))


def classify_tables(cells: DataFrame, scan_rows: int | None = SCAN_ROWS) -> DataFrame:
    """doc, sheet, kind, confidence, evidence, generic_name (a bare name column counts) and automatic (its rows may count as work volume)."""
    out = table_text(cells, scan_rows)
    out = once(out, cells=F.col("cells"), text=F.col("text"))
    out = once(out, **{f"{name}_": T.phrases_found(F.col("text"), phrases, T.normalize_table) for name, phrases in L.TABLE_PHRASES.items()})
    start, finish = F.arrays_overlap("cells", F.array(*map(F.lit, L.START_HEADERS))), F.arrays_overlap("cells", F.array(*map(F.lit, L.FINISH_HEADERS)))
    scale = F.exists("cells", lambda c: F.regexp_like(c, F.lit(L.CALENDAR_CELL)))
    out = once(out, start_=start, finish_=finish, scale_=scale)
    start, finish, scale = F.col("start_"), F.col("finish_"), F.col("scale_")
    price = F.arrays_overlap("mixed_", F.array(*map(F.lit, L.PRICE_PHRASES)))
    mixed = F.array_contains("mixed_", L.MIXED_PHRASE) & price
    schedule = (F.size("schedule_") >= 2) | (start & finish & (scale | (F.size("schedule_") >= 1)))
    work = (F.size("work_") >= 1) & ~price
    material = (F.size("material_") >= 1) & (F.size("work_") == 0)
    kind = F.when(mixed, "mixed-work-material-price-table").when(schedule, "schedule-table").when(work, "work-volume").when(material, "material-table").otherwise("unknown-table")
    none = F.array().cast("array<string>")
    extra = F.filter(F.array(F.when(start, "колонка «Начало»"), F.when(finish, "колонка «Окончание»"), F.when(scale, "календарная шкала")), lambda x: x.isNotNull())
    evidence = F.when(mixed, F.col("mixed_")).when(schedule, F.concat("schedule_", extra)).when(work, F.col("work_")).when(material, F.col("material_")).otherwise(none)
    sure = F.when(mixed | schedule | work, "high").when(material, "medium").otherwise("low")
    return out.select(*SHEET, kind.alias("kind"), sure.alias("confidence"), evidence.alias("evidence"), (mixed | (~schedule & work)).alias("generic_name"), (~mixed & ~schedule & work).alias("automatic"))


def header_score(cell: Column, aliases: list[str]) -> Column:
    """5 for an alias, 4 if the cell contains one of five letters or more, else 0. cell is normalised."""
    out = F.lit(0)
    forms = [T.normalize_table(F.lit(a)) for a in aliases]
    for f in forms:
        out = F.greatest(out, F.when(cell == f, 5).when((F.length(f) >= 5) & F.contains(cell, f), 4).otherwise(0))
    return F.when(cell == "", 0).otherwise(out)


def header_rows(cells: DataFrame, kinds: DataFrame, scan_rows: int | None = SCAN_ROWS) -> DataFrame:
    """doc, sheet, row_idx, score and for each role its column and score, for the first rows; the first of equal columns counts."""
    head = _head(cells, scan_rows).join(kinds.select(*SHEET, "generic_name"), SHEET)
    head = once(head, v=T.normalize_table("value"))
    aggs = []
    for role, aliases in L.HEADER_ALIASES.items():
        score = header_score(F.col("v"), aliases)
        if role == "work":
            score = F.when((F.col("v") == L.GENERIC_NAME_HEADER) & ~F.col("generic_name"), 0).otherwise(score)
        aggs.append(F.min(F.when(score > 0, F.struct((-score).alias("negative"), F.col("col_idx").alias("col")))).alias(role))
    rows = head.groupBy(*SHEET, "row_idx").agg(*aggs)
    points = sum((F.coalesce(-F.col(f"{r}.negative"), F.lit(0)) for r in ("work", "unit", "quantity")), F.lit(0))
    return rows.select(*SHEET, "row_idx", points.cast("int").alias("score"), *[F.col(f"{r}.col").alias(f"{r}_col") for r in L.HEADER_ALIASES])


def find_headers(cells: DataFrame, kinds: DataFrame, scan_rows: int | None = SCAN_ROWS) -> DataFrame:
    """The best complete header row of each sheet, the earliest of equals, with its confidence."""
    rows = header_rows(cells, kinds, scan_rows).where("work_col is not null and unit_col is not null and quantity_col is not null")
    best = rows.groupBy(*SHEET).agg(F.min(F.struct((-F.col("score")).alias("negative"), "row_idx", *[f"{r}_col" for r in L.HEADER_ALIASES])).alias("h"))
    score = -F.col("h.negative")
    sure = F.when(score >= 14, "high").when(score >= 11, "medium").otherwise("low")
    return best.select(*SHEET, F.col("h.row_idx").alias("header_row"), score.alias("header_score"), sure.alias("header_confidence"), *[f"h.{r}_col" for r in L.HEADER_ALIASES])


def with_row_type(rows: DataFrame, name: str, looks_like_work: Column | None = None, out: str = "row_type") -> DataFrame:
    """Adds the type of a row and out + "_mark", the phrase that tells it, from its work name."""
    known = looks_like_work if looks_like_work is not None else F.lit(False)
    text = once(rows, text_=T.normalize_table(T.clean_work_name(name)), known_=known)
    mark, known = {k: F.col(f"{k}_mark_") for k in L.ROW_PREFIXES}, F.col("known_")
    marked = once(text, **{f"{k}_mark_": T.starts_with_any(F.col("text_"), v) for k, v in L.ROW_PREFIXES.items()})
    kind = (
        F.when(F.col("text_") == "", "uncertain").when(mark["summary"].isNotNull(), "summary").when(mark["section"].isNotNull(), "section").when(mark["strong_machinery"].isNotNull(), "machinery")
        .when(mark["work"].isNotNull() | known, "work").when(mark["material"].isNotNull(), "material").when(mark["machinery"].isNotNull(), "machinery").otherwise("uncertain")
    )
    told = F.coalesce(mark["summary"], mark["section"], mark["strong_machinery"], mark["work"], F.when(~known, F.coalesce(mark["material"], mark["machinery"])))
    return marked.withColumns({out: kind, f"{out}_mark": told}).drop("text_", "known_", *[f"{k}_mark_" for k in L.ROW_PREFIXES])


def schedule_review(start: Column, finish: Column) -> Column:
    """Reasons to review a schedule row: one-date, order, long."""
    days = duration_days(start, finish)
    reasons = F.array(
        F.when(start.isNull() != finish.isNull(), "one-date"),
        F.when(start.isNotNull() & finish.isNotNull() & days.isNull(), "order"),
        F.when(days > LONG_DAYS, "long"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def analyze_sheets(cells: DataFrame, looks_like_work=None, limit: int | None = None, scan_rows: int | None = SCAN_ROWS) -> DataFrame:
    """Typed rows of every sheet with a header: work name, unit, quantity, dates, row type and review reasons; all of them, or the first ``limit`` of each sheet.

    looks_like_work: Column -> Column, whether a work name is known to the taxonomy, as known_family() tells. Cells in a
    column with a role become one row for each row of a sheet, so sheets of any size are spread over tasks by their rows.
    """
    kinds = classify_tables(cells, scan_rows)
    heads = find_headers(cells, kinds, scan_rows).join(kinds, SHEET)
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_col").alias("col_idx")) for r in L.HEADER_ALIASES])).alias("r")
    told = heads.select(*SHEET, "header_row", "kind", "automatic", roles).select(*SHEET, "header_row", "kind", "automatic", "r.role", "r.col_idx").where("col_idx is not null")
    # a sheet's header, at most one short row for each role, goes to the sheet's cells, never the cells to it
    named = cells.join(F.broadcast(told), [*SHEET, "col_idx"]).where(F.col("row_idx") > F.col("header_row"))
    # dealt by rows before they are put side by side: maxima of texts are sorted for, and no task sorts more than its share
    rows = named.repartition(*SHEET, "row_idx").groupBy(*SHEET, "row_idx", "kind", "automatic").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(f"{r}_raw") for r in L.HEADER_ALIASES])
    rows = once(rows, work_name=T.clean_work_name("work_raw"), unit=table_unit("unit_raw"), quantity=parse_number("quantity_raw"))
    rows = rows.where("length(work_name) >= 3 and unit <> '' and quantity > 0")
    rows = once(rows, start=parse_date("start_date_raw"), finish=parse_date("finish_date_raw"))
    known = looks_like_work(F.col("work_name")) if looks_like_work else F.lit(False)
    is_schedule, both, neither = F.col("kind") == "schedule-table", F.col("start").isNotNull() & F.col("finish").isNotNull(), F.col("start").isNull() & F.col("finish").isNull()
    out = with_row_type(rows, "work_name", known, "base_")
    final = F.when(is_schedule & both & (F.col("base_") == "uncertain"), "work").when(is_schedule & neither & F.contains("work_name", F.lit(":")), "section").otherwise(F.col("base_"))
    reasons = F.when(is_schedule, schedule_review(F.col("start"), F.col("finish"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"row_type": final, "duration_days": duration_days(F.col("start"), F.col("finish")), "review": reasons, "automatic": F.col("automatic") & (final == "work") & (F.col("base_") == "work")})
    out = out.drop("base_", "base__mark", *[f"{r}_raw" for r in L.HEADER_ALIASES])
    if limit is None:
        return out
    w = Window.partitionBy(*SHEET).orderBy("row_idx")
    return out.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= limit).drop("n_")


def known_family(taxonomy: Mapping[str, Any] = L.TAXONOMY):
    """For analyze_sheets(): does a work name have all roots of a family of the taxonomy?"""

    def known(name: Column) -> Column:
        there = T.roots(T.tokens_taxonomy(name))
        has = lambda root: F.exists(there, lambda r: T.roots_match(r, F.lit(root)))
        out = F.lit(False)
        for spec in taxonomy.values():
            test = F.lit(True)
            for root in spec["required"]:
                test = test & has(root)
            out = out | test
        return out

    return known


def split_by_type(rows: DataFrame) -> dict[str, DataFrame]:
    """Analysed rows by what they become: works, materials, machinery, and rows to look at."""
    return {name: rows.where(F.col("row_type") == kind) for name, kind in (("works", "work"), ("materials", "material"), ("machinery", "machinery"), ("uncertain", "uncertain"))}


def row_type_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    kinds = ["work", "material", "machinery", "section", "summary", "uncertain"]
    return rows.groupBy(*by).agg(*[F.count_if(F.col("row_type") == k).alias(k) for k in kinds])


def uncertain_groups(rows: DataFrame, document: str, name: str, order: list[str]) -> DataFrame:
    """Rows of uncertain type by document: count and the first three names."""
    vague = rows.where("row_type = 'uncertain'").select(F.col(document).alias("d_"), F.col(name).alias("name_"), F.struct(*order).alias("o_"))
    # the filter on the place alone is what lets every task rank its own first rows before anything is shuffled
    ranked = vague.withColumn("n_", F.row_number().over(Window.partitionBy("d_").orderBy("o_"))).where(F.col("n_") <= 3)
    first = ranked.groupBy("d_").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_", "name_"))), lambda x: x["name_"]).alias("examples"))
    sums = vague.groupBy(F.col("d_").alias("k_")).agg(F.count("*").alias("n"))
    return sums.join(first, F.col("k_").eqNullSafe(F.col("d_"))).select(F.col("k_").alias(document), "n", "examples")


def structure_kind(kinds: Column) -> Column:
    """Kind of a workbook from the kinds of its sheets, by precedence."""
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("schedule-table"), "schedule").when(has("work-volume"), "work-volume").when(has("material-table"), "specification").when(has("mixed-work-material-price-table"), "commercial-proposal")


def find_volume(rows: DataFrame, work: Column, alternatives: int = 5) -> DataFrame:
    """The best row for an active work: candidates by coverage of its roots; eligible from 55 on when automatic; the best needs 70."""
    wanted = T.roots(T.tokens_table(work))
    scored = rows.withColumn("score", T.js_round(T.coverage(wanted, T.roots(T.tokens_table("work_name"))) * 100).cast("int"))
    fit = scored.where(F.col("automatic") & (F.col("score") >= 55))
    w = Window.orderBy(F.col("score").desc(), "doc", "sheet", "row_idx")
    top = fit.orderBy(F.col("score").desc(), "doc", "sheet", "row_idx").limit(alternatives + 1).withColumn("place", F.row_number().over(w))
    return top.withColumn("chosen", (F.col("place") == 1) & (F.col("score") >= 70)).withColumn("confidence", F.when(F.col("score") >= 85, "high").otherwise("medium"))
