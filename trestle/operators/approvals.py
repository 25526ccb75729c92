"""Approvals in page text: hits, sentence contexts, intent, type, organisation and grouping of repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.functions.rows import once
from trestle.operators.quantity import hits
from trestle.sources.scratch import cut

#: Characters within which the same approval on one page is a repeat.
NEAR_CHARS = 140


def first_matching(text: Column, rules, default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(F.regexp_like(text, F.lit(T.by_letters(pattern))), F.lit(value)).otherwise(out)
    return out


@dataclass(frozen=True)
class ApprovalRules:
    """What approvals look like: the action's pattern; a drawing's title block; and, each by the first pattern that matches the context, type, organisation and intent."""

    action: str = L.APPROVAL_ACTION
    stamp_markers: tuple = tuple(L.STAMP_MARKERS)
    stamp_action: str = L.STAMP_REAL_ACTION
    types: tuple = tuple(L.APPROVAL_TYPES)
    organizations: tuple = tuple(L.ORGANIZATIONS)
    organization_unknown: str = L.ORGANIZATION_UNKNOWN
    intents: tuple = tuple(L.APPROVAL_INTENTS)


RUSSIAN = ApprovalRules()


def _stamped(normal: Column, rules: ApprovalRules) -> Column:
    return (T.patterns_matched(normal, rules.stamp_markers) >= 3) & ~F.regexp_like(normal, F.lit(rules.stamp_action))


def is_stamp(context: Column, rules: ApprovalRules = RUSSIAN) -> Column:
    """A drawing's title block: three markers or more and no real action."""
    return _stamped(T.normalize_intake(context), rules)


def approval_type(context: Column, rules: ApprovalRules = RUSSIAN) -> Column:
    return first_matching(T.normalize_intake(context), rules.types, F.lit("approval"))


def organization(context: Column, rules: ApprovalRules = RUSSIAN) -> Column:
    return first_matching(T.normalize_intake(context), rules.organizations, F.lit(rules.organization_unknown))


def intent(context: Column, rules: ApprovalRules = RUSSIAN) -> Column:
    return first_matching(T.normalize_intake(context), [(p, i) for p, i, _ in rules.intents], F.lit("informational"))


def priority(intent_: Column) -> Column:
    return F.when(intent_ == "prerequisite", "high").when(intent_ == "informational", "low").otherwise("medium")


def extract_approvals(pages: DataFrame, rules: ApprovalRules = RUSSIAN, limit: int | None = None, key_chars: int = 160) -> DataFrame:
    """One row per distinct approval of a page: doc, page, index, matched, context, type, intent, priority, organization, signature; all of a document, or the first ``limit``.

    Approvals of a page are one if they have type, intent and the first ``key_chars`` characters of their context in common.
    """
    rows = pages.select("doc", "page", "text", F.explode(hits(F.col("text"), rules.action)).alias("h")).select("doc", "page", "text", F.col("h.index").alias("index"), F.col("h.raw").alias("matched"))
    start = F.greatest(F.col("index") - 190, F.lit(0))
    wide = T.collapse(F.substring("text", start + 1, F.least(F.col("index") + F.length("matched") + 250, F.length("text")) - start))
    context = T.sentence_around(F.col("text"), F.col("index"), F.length("matched"))
    rows = once(rows, context=context, wide=wide).drop("text").where(F.length("context") >= 20)
    rows = once(rows, near_=T.normalize_intake("context"), wide_=T.normalize_intake("wide"))
    near, title = F.col("near_"), _stamped(F.col("wide_"), rules)
    rows = once(rows, intent=first_matching(near, [(p, i) for p, i, _ in rules.intents], F.lit("informational"))).where((F.col("intent") != "informational") & ~title)
    told = {"type": first_matching(near, rules.types, F.lit("approval")), "organization": first_matching(near, rules.organizations, F.lit(rules.organization_unknown))}
    rows = rows.withColumns(told | {"priority": priority(F.col("intent")), "signature": T.signature(near), "key": F.substring(near, 1, key_chars)})
    first = rows.groupBy("doc", "page", "type", "intent", "key").agg(F.min(F.struct("index", "matched", "context", "organization", "priority", "signature")).alias("f")).select("doc", "page", "type", "intent", "f.*")
    if limit is None:
        return first
    w = Window.partitionBy("doc").orderBy("page", "index")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


KEY = ["doc", "type", "organization", "intent"]


def _founders_of_pages(rows: DataFrame, founders: DataFrame, near: int) -> DataFrame:
    """The rows with told (the founder of their signature, if it stands on an earlier page) and founder (the index of the row of their page that founds their group, else null).

    A page is read in order: a row joins the first founder before it that has its signature or lies near, or founds a group.
    """
    known = founders.select(*[F.col(c).alias(f"f_{c}") for c in (*KEY, "signature")], F.struct("page", "index").alias("told"))
    same = F.col("signature") == F.col("f_signature")
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    met = rows.join(known, same & (F.col("told.page") < F.col("page")), "left").select(*rows.columns, "told")
    pages = met.groupBy(*KEY, "page").agg(F.array_sort(F.collect_list(F.struct("index", "signature", "told"))).alias("rows"))  # the hits of one page, whose text lay in one row
    group, out = "array<struct<index:int,signature:string>>", "array<struct<index:int,signature:string,told:struct<page:bigint,index:int>,founder:int>>"

    def step(acc: Column, x: Column) -> Column:
        fit = F.get(F.filter(acc["g"], lambda g: (g["signature"] == x["signature"]) | (F.abs(g["index"] - x["index"]) <= near)), F.lit(0))
        new = x["told"].isNull() & fit["index"].isNull()
        founder = F.when(x["told"].isNull(), F.coalesce(fit["index"], x["index"]))
        return F.struct(
            F.when(new, F.array_append(acc["g"], F.struct(x["index"].alias("index"), x["signature"].alias("signature")))).otherwise(acc["g"]).alias("g"),
            F.array_append(acc["out"], F.struct(x["index"].alias("index"), x["signature"].alias("signature"), x["told"].alias("told"), founder.alias("founder"))).alias("out"),
        )

    start = F.struct(F.array().cast(group).alias("g"), F.array().cast(out).alias("out"))
    return pages.select(*KEY, "page", F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("r")).select(*KEY, "page", "r.*")


def _founding(read: DataFrame) -> DataFrame:
    first = read.where("founder = index").groupBy(*KEY, "signature").agg(F.min(F.struct("page", "index")).alias("f"))
    return first.select(*KEY, "signature", "f.page", "f.index")


def link_approvals(found: DataFrame, near: int = NEAR_CHARS) -> DataFrame:
    """doc, type, organization, intent, page, index, group_page and group_index: the approval of equal doc, type, organisation and intent that each one repeats, or itself.

    In order of reading, an approval joins the first group whose founder has its signature, or lies on its page within ``near``
    characters; else it founds a group. Nearness counts on a page only and signatures meet by equality, so pages are read
    apart from each other, given who founded which signature before. That is guessed from the first occurrences and put right
    in rounds: a round gives every page's founders, and the k-th page of a document is right after k rounds at most, in
    practice after two or three. No row holds more than the approvals of one page.
    """
    rows = cut(found.select(*KEY, F.col("page").cast("bigint").alias("page"), F.col("index").cast("int").alias("index"), "signature").distinct(), "approvals")
    first = rows.groupBy(*KEY, "signature").agg(F.min(F.struct("page", "index")).alias("f")).select(*KEY, "signature", "f.page", "f.index")
    while True:
        read = cut(_founders_of_pages(rows, first, near), "approvals")
        now = _founding(read)
        if now.exceptAll(first).isEmpty() and first.exceptAll(now).isEmpty():
            return read.select(*KEY, "page", "index", F.coalesce("told.page", "page").alias("group_page"), F.coalesce("told.index", "founder").alias("group_index"))
        first = cut(now, "founders")


def group_approvals(found: DataFrame, near: int = NEAR_CHARS) -> DataFrame:
    """One row per approval with its repeats: doc, type, organization, intent, page and index of the founder, its signature and context, pages (how many have it) and occurrences."""
    found = cut(found, "approvals")
    links = link_approvals(found, near)
    sums = links.groupBy(*KEY, "group_page", "group_index").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("occurrences"))
    named = found.select(*[F.col(c).alias(f"g_{c}") for c in KEY], F.col("page").cast("bigint").alias("page"), F.col("index").cast("int").alias("index"), "signature", "context").dropDuplicates([*(f"g_{c}" for c in KEY), "page", "index"])
    same = (F.col("group_page") == F.col("page")) & (F.col("group_index") == F.col("index"))
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return sums.join(named, same).select(*KEY, "page", "index", "signature", "context", "pages", "occurrences")
