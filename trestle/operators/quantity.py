"""Quantities in page text: hits with offsets, evidence windows and scores against a work's profile.

A profile row has work_name, family_roots, variant_markers and resource_names (arrays); it is one active work. What scoring
needs of it is made once for each profile, and an evidence window is read once for each quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.functions.rows import once
from trestle.functions.parse import parse_loose_number, quantity_unit

FLAGS = "(?iu)"


def hits(text: Column, pattern: str) -> Column:
    """Array of (raw, index): the pattern's occurrences with 0-based offsets. Each is looked for behind the one before."""
    found = F.regexp_extract_all(text, F.lit(f"{pattern}"), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<raw:string,index:int>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        place = F.call_function("locate", raw, text, acc["at"])
        return F.struct((place + F.length(raw)).cast("int").alias("at"), F.array_append(acc["out"], F.struct(raw.alias("raw"), (place - 1).cast("int").alias("index"))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def extract_quantities(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per quantity above zero: the page's columns, raw, index, quantity and unit."""
    rows = pages.where(F.regexp_like(text, F.lit(r"\d"))).withColumn("hit_", F.explode(hits(F.col(text), FLAGS + L.QUANTITY_PATTERN)))
    rows = rows.select("*", F.col("hit_.raw").alias("raw"), F.col("hit_.index").alias("index")).drop("hit_")
    number, unit = (F.regexp_extract("raw", FLAGS + L.QUANTITY_PATTERN, i) for i in (1, 2))
    rows = once(rows, number_=number, unit_=unit)
    out = once(rows, quantity=parse_loose_number("number_"), unit=quantity_unit("unit_")).drop("number_", "unit_")
    return out.where("quantity > 0")


def prepare_profile(profiles: DataFrame) -> DataFrame:
    """Profiles with what scoring reads of them, made once for each: work_roots (distinct) and markers (form and roots)."""
    work = F.array_distinct(T.roots(T.tokens_quantity("work_name")))
    markers = F.transform("variant_markers", lambda m: F.struct(T.normalize_quantity(m).alias("form"), T.roots(T.tokens_quantity(m)).alias("roots")))
    return profiles.withColumns({"work_roots": work, "markers": markers})


def score_quantities(candidates: DataFrame, text: str = "text", priority: str = "priority", normal: str | None = None) -> DataFrame:
    """Adds evidence, score (0 to 100), eligible and kind. Rows carry a profile (see prepare_profile): family_roots, work_roots, markers and resource_names.

    normal: a column with T.quantity_chars() of the text, made once for each page; windows are cut out of it.
    """
    window = lambda c: T.window_around(F.col(c), F.col("index"), 260, 120)
    own = T.normalize_quantity(window(text))
    out = once(candidates, e_=own if normal is None else F.when(F.col(normal).isNull(), own).otherwise(window(normal)), raw_=T.normalize_quantity("raw"))
    out = out.withColumn("evidence", window(text))
    # distinct words first, so that a word is stemmed once
    out = once(out, roots_=T.roots(F.array_distinct(T.tokens_quantity("e_", normalized=True))), last_=F.length("e_") - F.call_function("locate", F.reverse("raw_"), F.reverse("e_")) + 1 - F.length("raw_"))
    family = F.when(F.size("family_roots") == 0, 0.0).otherwise(F.size(T.matched_roots(F.col("family_roots"), F.col("roots_"))) / F.size("family_roots"))
    work = T.coverage(F.col("work_roots"), F.col("roots_"))
    marker = F.exists("markers", lambda m: (m["form"] != "") & (F.contains("e_", m["form"]) | F.exists(m["roots"], lambda r: F.exists("roots_", lambda x: T.roots_match(r, x)))))
    intent = F.lit(False)
    for p in L.INTENT_PHRASES:
        intent = intent | F.contains("e_", T.normalize_quantity(F.lit(p)))
    last, there = F.col("last_"), F.contains("e_", F.col("raw_"))
    local = F.when(there, F.substring("e_", F.greatest(last - 90, F.lit(0)) + 1, F.least(last, F.lit(90)))).otherwise(F.substring("e_", F.greatest(F.length("e_") - 120, F.lit(0)) + 1, F.lit(120)))
    out = once(out, family_=family, work_=work, variant_=marker, intent_=intent, local_=local)
    resource = F.exists("resource_names", lambda r: (F.length(r) >= 3) & F.contains("local_", r))
    out = once(out, near_resource=resource)
    points = F.col("family_") * 40 + F.col("work_") * 15 + F.when(F.col("variant_"), 15).otherwise(0) + F.when(F.col("intent_"), 15).otherwise(0) + F.col(priority) / 100 * 10
    points = points + F.when(F.col("unit").isin(*L.KNOWN_QUANTITY_UNITS), 5).otherwise(0) - F.when(F.col("near_resource"), 35).otherwise(0)
    strong = (F.col("family_") >= 1) & (F.col("variant_") | F.col("intent_") | (F.col("work_") >= 0.75))
    out = out.withColumns({"score": F.greatest(F.lit(0), F.least(T.js_round(points), F.lit(100))).cast("int"), "eligible": strong & ~F.col("near_resource"), "kind": F.when(F.col("near_resource"), "material-quantity").otherwise("work-quantity-candidate")})
    return out.drop("raw_", "last_", "e_", "roots_", "family_", "work_", "variant_", "intent_", "local_")


def confidence(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "medium").when(score >= 55, "low").otherwise("none")


def best_quantities(scored: DataFrame, by: list[str], order: list[str], least: int = 45, alternatives: int = 5) -> DataFrame:
    """For each group: ranked candidates from ``least`` points on, by score and source priority; chosen is the first eligible one of 55 or more; ranks 2 to 6 of all are alternatives."""
    kept = scored.where(F.col("score") >= least)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("priority").desc(), *order)
    ranked = kept.withColumn("place", F.row_number().over(w))
    fit = F.col("eligible") & (F.col("score") >= 55)
    first = F.min(F.when(fit, F.col("place"))).over(Window.partitionBy(*by))
    out = ranked.withColumn("chosen", F.coalesce(F.col("place") == first, F.lit(False)))
    return out.where((F.col("place") <= alternatives + 1) | F.col("chosen")).withColumn("confidence", confidence(F.col("score")))
