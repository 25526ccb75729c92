"""Documents: kind by weighted phrases and by signals, fused kinds, and material rows in page text.

Pages come as doc, page, text. Phrase and signal tables are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.functions.parse import mapping, material_unit
from trestle.functions.rows import let, once

#: Characters at the start of a text that count as its lead.
LEAD_CHARS = 2000


def phrase_scores(text: Column, kinds: Mapping[str, Sequence[tuple[str, int]]], normalize=T.normalize_plain) -> Column:
    """Array of (negative score, ord, kind, matched phrases) of every kind, best first. text is normalised."""
    asked = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.array(*[F.struct(F.lit(p).alias("phrase"), normalize(F.lit(p)).alias("form"), F.lit(w).alias("weight")) for p, w in phrases]).alias("of"))
        for i, (kind, phrases) in enumerate(kinds.items())
    ])
    # each phrase is counted once, and only where it occurs
    points = lambda p: F.when(F.contains(text, p["form"]), T.phrase_count(text, p["form"]) * p["weight"]).otherwise(0)
    counted = F.transform(asked, lambda k: F.struct(k["ord"].alias("ord"), k["kind"].alias("kind"), F.transform(k["of"], lambda p: F.struct(p["phrase"].alias("phrase"), points(p).alias("n"))).alias("of")))
    scored = F.transform(counted, lambda k: F.struct(
        (-F.aggregate(k["of"], F.lit(0), lambda a, x: a + x["n"])).alias("negative"), k["ord"].alias("ord"), k["kind"].alias("kind"),
        F.transform(F.filter(k["of"], lambda x: x["n"] > 0), lambda x: x["phrase"]).alias("phrases"),
    ))
    return F.array_sort(scored, lambda a, b: F.when(a["negative"] != b["negative"], F.signum(a["negative"] - b["negative"])).otherwise(F.signum(a["ord"] - b["ord"])).cast("int"))


def classify_documents(pages: DataFrame, kinds: Mapping[str, Sequence[tuple[str, int]]] = L.DOCUMENT_KINDS, cover: str | None = L.COVER_PATTERN, max_phrases: int | None = None) -> DataFrame:
    """doc, kind, confidence, score, second_score and phrases (all, or the first max_phrases). A cover phrase on the first three pages decides; else the best score from 4 on."""
    norm = once(pages.select("doc", "page", "text"), t=T.normalize_plain("text"))
    front = F.regexp_like("t", F.lit(cover)) & (F.col("page") <= 3) if cover else F.lit(False)
    docs = norm.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), " ").alias("t"), F.bool_or(front).alias("cover"))
    out = once(once(docs, t=F.col("t")), ranked=phrase_scores(F.col("t"), kinds))
    best, second = -F.get("ranked", F.lit(0))["negative"], F.coalesce(-F.get("ranked", F.lit(1))["negative"], F.lit(0))
    known = best >= 4
    named = F.get("ranked", F.lit(0))["phrases"]
    shown = named if max_phrases is None else F.slice(named, 1, max_phrases)
    sure = F.when(F.trim("t") == "", "none").when(F.col("cover"), "high").when(~known, "low").when((best >= 12) & (best >= second * 1.5), "high").when(best >= 7, "medium").otherwise("low")
    kind = F.when(F.col("cover"), "working-documents").when(known, F.get("ranked", F.lit(0))["kind"]).otherwise("unknown")
    phrases = F.when(known & ~F.col("cover"), shown).otherwise(F.array().cast("array<string>"))
    return out.select("doc", kind.alias("kind"), sure.alias("confidence"), best.alias("score"), second.alias("second_score"), phrases.alias("phrases"))


def signal_scores(name: Column, text: Column, signals: Mapping[str, Mapping[str, Sequence[str]]] = L.SIGNALS, lead_chars: int = LEAD_CHARS) -> Column:
    """text is normalised (normalize_intake). Array of (negative score, ord, kind, file, body, lead, strong_file, strong_lead), best first."""
    # texts, then counts, then scores: what is read more than once is made once
    texts = F.struct(T.normalize_intake(name).alias("file"), text.alias("body"), F.when(F.length(text) > lead_chars, F.substring(text, 1, lead_chars)).alias("lead"))

    def counts(t: Column) -> Column:
        out = []
        for i, (kind, s) in enumerate(signals.items()):
            n = [T.patterns_matched(t[w], s[p]).alias(f"{w}_{p}") for w in ("file", "body") for p in ("strong", "weak")]
            lead = [F.when(t["lead"].isNotNull(), T.patterns_matched(t["lead"], s[p])).alias(f"lead_{p}") for p in ("strong", "weak")]
            out.append(F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), *n, *lead))
        return F.array(*out)

    def score(k: Column) -> Column:
        lead_strong, lead_weak = (F.coalesce(k[f"lead_{p}"], k[f"body_{p}"]) for p in ("strong", "weak"))  # a short text is its own lead
        file_score, body_score, lead_score = k["file_strong"] * 12 + k["file_weak"] * 5, k["body_strong"] * 6 + k["body_weak"] * 2, lead_strong * 14 + lead_weak * 4
        return F.struct((-(file_score + body_score + lead_score)).alias("negative"), k["ord"].alias("ord"), k["kind"].alias("kind"), file_score.alias("file"), body_score.alias("body"), lead_score.alias("lead"), (k["file_strong"] > 0).alias("strong_file"), (lead_strong > 0).alias("strong_lead"))

    return F.sort_array(F.transform(let(texts, counts), score))


def classify_signals(rows: DataFrame, name: str, text: str, signals: Mapping[str, Mapping[str, Sequence[str]]] = L.SIGNALS) -> DataFrame:
    """Adds signal_kind (null without any signal), signal_confidence, signal_score and strong_file."""
    out = once(once(rows, body_=T.normalize_intake(text)), ranked_=signal_scores(F.col(name), F.col("body_"), signals))
    best, second = F.get("ranked_", F.lit(0)), F.get("ranked_", F.lit(1))
    score = -best["negative"]
    sure = best["strong_file"] | best["strong_lead"] | ((score >= 12) & (score >= -second["negative"] + 5))
    out = out.drop("body_")
    some = score > 0
    return out.withColumns({"signal_kind": F.when(some, best["kind"]), "signal_confidence": F.when(some, F.when(sure, "high").otherwise("medium")), "signal_score": score, "strong_file": some & best["strong_file"]}).drop("ranked_")


def fuse_kinds(signal_kind: Column, signal_confidence: Column, text_kind: Column, text_confidence: Column, kinds: Mapping[str, str] = L.INTAKE_KIND) -> dict[str, Column]:
    """kind, confidence and conflict of a text document from its signals and its phrase score. kinds: intake kinds of the phrase kinds."""
    known = mapping(kinds)[text_kind]
    both, agree = signal_kind.isNotNull() & known.isNotNull(), signal_kind == known
    high = (signal_confidence == "high") | (text_confidence == "high")
    kind = F.when(both & ~agree, F.when(signal_confidence == "high", signal_kind).otherwise(known)).otherwise(F.coalesce(signal_kind, known, F.lit("other")))
    confidence = F.when(both & agree, F.when(high, "high").otherwise("medium")).when(both, "medium").when(signal_kind.isNotNull(), signal_confidence).when(known.isNotNull(), text_confidence).otherwise("low")
    return {"kind": kind, "confidence": confidence, "conflict": F.coalesce(both & ~agree, F.lit(False))}


def fuse_table_kinds(signal_kind: Column, signal_confidence: Column, strong_file: Column, structure: Column, structure_confidence: Column) -> dict[str, Column]:
    """kind, confidence and conflict of a workbook from its signals and its sheets' structure."""
    both = signal_kind.isNotNull() & structure.isNotNull()
    strong = F.coalesce(strong_file, F.lit(False))
    priced = both & (structure == "commercial-proposal") & signal_kind.isin("estimate", "commercial-proposal")
    agree = both & (signal_kind == structure)
    kind = F.when(strong | priced | agree, signal_kind).when(both, structure).otherwise(F.coalesce(signal_kind, structure, F.lit("other")))
    confidence = (
        F.when(strong, "high").when(priced, F.when(signal_confidence == "high", "high").otherwise("medium"))
        .when(agree, F.when((signal_confidence == "high") | (structure_confidence == "high"), "high").otherwise("medium"))
        .when(both, "medium").otherwise(F.coalesce(signal_confidence, structure_confidence, F.lit("low")))
    )
    return {"kind": kind, "confidence": confidence, "conflict": F.coalesce(both & (signal_kind != structure), F.lit(False))}


def is_material_page(text: Column) -> Column:
    """text is normalised (normalize_plain)."""
    t = text
    return (T.patterns_matched(t, L.MATERIAL_PAGE_STRONG) > 0) | (T.patterns_matched(t, L.MATERIAL_PAGE_MARKERS) >= 3)


def is_material_name(name: Column, plain: Column | None = None) -> Column:
    """plain: the name normalised, if it is there already."""
    t = T.normalize_plain(name) if plain is None else plain
    fine = (t != "") & (F.size(F.split(t, " ")) <= 18) & (T.patterns_matched(t, L.MATERIAL_NOISE) == 0) & (T.patterns_matched(t, L.MATERIAL_WORK_VERBS) == 0)
    return fine & (F.regexp_like(t, F.lit("|".join(L.MATERIAL_STEMS))) | F.regexp_like(T.collapse(name), F.lit(L.MODEL_CODE)))


def extract_materials(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Material rows of page text: doc, page, line_no, name, quantity, unit; each once for a page; all of a document, or the first ``limit`` in order of reading."""
    pages = once(pages.select("doc", "page", "text"), plain_=T.normalize_plain("text")).where(is_material_page(F.col("plain_")))
    lines = pages.select("doc", "page", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", L.MATERIAL_ROW, i)
    rows = once(once(lines, line=F.trim("line")), one_=part(1)).where("one_ <> ''")
    rows = once(rows, name=T.material_name("one_"), quantity=F.replace(part(3), F.lit(","), F.lit(".")).cast("double"), two_=part(2)).where((F.length("name") >= 3) & (F.col("quantity") > 0))
    rows = once(rows, plain_=T.normalize_plain("name"), unit=material_unit("two_")).where(is_material_name(F.col("name"), F.col("plain_")))
    first = rows.groupBy("doc", "page", F.lower("name").alias("k"), "quantity", "unit").agg(F.min(F.struct("line_no", "name")).alias("f"))
    if limit is not None:
        w = Window.partitionBy("doc").orderBy("page", "f.line_no")
        first = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return first.select("doc", "page", F.col("f.line_no").alias("line_no"), F.col("f.name").alias("name"), "quantity", "unit")
