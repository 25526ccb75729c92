"""Work identification: taxonomy, matching against a knowledge base, overlays and the completeness audit.

Rules and knowledge are tables of the caller's: small ones, sent to all tasks only while Spark measures them as small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.operators import matching
from trestle.sources.scratch import cut


def confidence(score: Column, high: float, medium: float, low: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("none")


def classify_taxonomy(rows: DataFrame, name: str, taxonomy: Mapping[str, Any] = L.TAXONOMY) -> DataFrame:
    """Adds family, variant, variant_score, second_score, alternatives and decision for a work name.

    A family needs all its roots. The best-scoring variant stands if it has 50 or more and leads the second by 15.
    """
    out = rows.withColumn("roots_", T.roots(T.tokens_taxonomy(name))).withColumn("text_", T.normalize_work(name))
    has = lambda root: F.exists("roots_", lambda r: T.roots_match(r, F.lit(root)))
    found, scores = F.lit(None).cast("string"), F.array().cast("array<struct<negative:int,ord:int,variant:string>>")
    for family, spec in reversed(list(taxonomy.items())):
        test = F.lit(True)
        for root in spec["required"]:
            test = test & has(root)
        marks = []
        for i, (variant, markers) in enumerate(spec["variants"].items()):
            hits = [F.when(has(text) if kind == "root" else F.contains("text_", T.normalize_work(F.lit(text))), score).otherwise(0) for kind, text, score in markers]
            best = F.greatest(*hits) if len(hits) > 1 else hits[0]
            marks.append(F.struct((-best).cast("int").alias("negative"), F.lit(i).alias("ord"), F.lit(variant).alias("variant")))
        found = F.when(test, family).otherwise(found)
        scores = F.when(test, F.sort_array(F.array(*marks))).otherwise(scores)
    out = out.withColumn("family", found).withColumn("marks_", scores)
    score = lambda i: F.coalesce(-F.get("marks_", F.lit(i))["negative"], F.lit(0))
    out = out.withColumn("variant_score", score(0)).withColumn("second_score", score(1))
    ambiguous = (F.col("variant_score") > 0) & (F.col("second_score") > 0) & (F.col("variant_score") - F.col("second_score") < 15)
    clear = (F.col("variant_score") >= 50) & ~ambiguous
    decision = F.when(F.col("text_") == "", "name-required").when(F.col("family").isNull(), "family-not-found").when(clear, "family-and-variant-detected").when(ambiguous, "variant-ambiguous").otherwise("family-detected-variant-required")
    out = out.withColumn("variant", F.when(F.col("family").isNotNull() & clear, F.get("marks_", F.lit(0))["variant"])).withColumn("decision", decision)
    alternatives = F.slice(F.transform(F.filter("marks_", lambda m: m["negative"] < 0), lambda m: m["variant"]), 1, 3)
    return out.withColumn("alternatives", F.coalesce(alternatives, F.array().cast("array<string>"))).drop("roots_", "text_", "marks_")


def root_score(matched: Column, size: Column, asked: Column) -> Column:
    """0 to 92: of a candidate's ``size`` roots ``matched`` distinct ones are among the ``asked`` roots of a name."""
    cc, qc = matched / F.greatest(size, F.lit(1)), matched / F.greatest(asked, F.lit(1))
    return F.when((size >= 2) & (cc == 1), 92).otherwise(T.js_round((cc * 0.6 + qc * 0.4) * 60))


def match_score(query: Column, candidate: Column) -> Column:
    """0 to 100: how well a work name fits one name or alias of a known work."""
    q, c = T.normalize_work(query), T.normalize_work(candidate)
    qr, cr = T.roots(T.tokens_work(query)), T.roots(T.tokens_work(candidate))
    by_roots = root_score(F.size(F.array_distinct(T.matched_roots(cr, qr))), F.size(cr), F.size(qr))
    score = F.when(q == c, 100).when(F.contains(q, c), 92).when(F.contains(c, q), 88).otherwise(by_roots)
    return F.when((q == "") | (c == ""), 0).otherwise(F.least(score, F.lit(100))).cast("int")


def _entries(works: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """The distinct normalised names of a catalogue (entry, roots, size, ord of the first work) and their first works (entry, ord, work_id)."""
    held = works.select("work_id", "ord", F.explode("names").alias("n")).withColumn("entry", T.normalize_work("n")).where("entry <> ''").select("entry", "ord", "work_id").distinct()
    holders = held.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy("ord", "work_id"))).where(F.col("place") <= first).drop("place")
    roots = T.roots(T.tokens_work("entry"))
    entries = held.groupBy("entry").agg(F.min("ord").alias("ord")).select("entry", "ord", F.array_distinct(roots).alias("roots"), F.size(roots).alias("size"))
    return entries, holders


def match_works(queries: DataFrame, name: str, works: DataFrame, alternatives: int = 3, threshold: int = 40, hot: int = matching.HOT) -> DataFrame:
    """For each distinct name: work_id, score and confidence of the best work, and alternatives (work_id, score).

    works: work_id, ord and names (array of the name and its aliases; empty ones fit nothing). Names and works meet where one
    contains the other and where they share roots (see matching); only pairs that can be among the best are scored.
    """
    first = alternatives + 1
    names = queries.select(F.col(name).alias("name")).distinct().withColumn("ask", T.normalize_work("name"))
    asks = cut(names.select("ask").distinct().where("ask <> ''").withColumn("asked", T.roots(T.tokens_work("ask"))), "asks")
    entries, holders = _entries(works, first)
    entries = cut(entries, "entries")
    rooted = matching.sharing_roots(asks.select("ask", F.col("asked").alias("roots")), entries, first, hot)
    wide = matching.contained(entries.select(F.col("entry").alias("short")), asks.select(F.col("ask").alias("long"))).select(F.col("long").alias("ask"), F.col("short").alias("entry"))
    narrow = matching.contained(asks.select(F.col("ask").alias("short")), entries.select(F.col("entry").alias("long"))).select(F.col("short").alias("ask"), F.col("long").alias("entry"))
    # all that contain a name score alike, but for the name itself, which is among the wide ones
    narrow = narrow.join(entries.select("entry", "ord"), "entry").withColumn("place", F.dense_rank().over(Window.partitionBy("ask").orderBy("ord"))).where(F.col("place") <= first).select("ask", "entry")
    met = rooted.unionByName(wide).unionByName(narrow).distinct().join(asks, "ask").join(entries.select("entry", "roots", "size"), "entry")
    by_roots = root_score(F.size(T.matched_roots(F.col("roots"), F.col("asked"))), F.col("size"), F.size("asked"))
    score = F.when(F.col("ask") == F.col("entry"), 100).when(F.contains("ask", F.col("entry")), 92).when(F.contains("entry", F.col("ask")), 88).otherwise(by_roots)
    scored = met.select("ask", "entry", score.cast("int").alias("score")).where("score > 0").join(holders, "entry").groupBy("ask", "ord", "work_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "ord", "work_id")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
    ranked = best.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("place", "work_id", "score"))).alias("ranked"))  # at most ``first``
    out = names.join(ranked, "ask", "left")
    top, score = F.get("ranked", F.lit(0)), F.coalesce(F.get("ranked", F.lit(0))["score"], F.lit(0))
    rest = F.coalesce(F.slice("ranked", 2, alternatives), F.array().cast(out.schema["ranked"].dataType))
    return out.select(
        "name",
        F.when(score >= threshold, top["work_id"]).alias("work_id"),
        score.alias("score"),
        confidence(score, 85, 60, 40).alias("confidence"),
        F.transform(rest, lambda r: F.struct(r["work_id"].alias("work_id"), r["score"].alias("score"))).alias("alternatives"),
    )


def first_named(texts: DataFrame, text: str, works: DataFrame) -> DataFrame:
    """text and work_id: for each distinct text the first work, by ord, one of whose names contains it or is contained in it (empty ones fit nothing)."""
    keyed = texts.select(F.col(text).alias("text")).distinct().withColumn("t", T.normalize_plain("text")).where("t <> ''")
    held = works.select("work_id", "ord", F.explode("names").alias("n")).withColumn("n", T.normalize_plain("n")).where("n <> ''").groupBy("n").agg(F.min(F.struct("ord", "work_id")).alias("w"))
    asks, named = keyed.select("t").distinct(), held.select("n")
    inside = matching.contained(named.withColumnRenamed("n", "short"), asks.withColumnRenamed("t", "long")).select(F.col("long").alias("t"), F.col("short").alias("n"))
    around = matching.contained(asks.withColumnRenamed("t", "short"), named.withColumnRenamed("n", "long")).select(F.col("short").alias("t"), F.col("long").alias("n"))
    first = inside.unionByName(around).join(held, "n").groupBy("t").agg(F.min("w").alias("w"))
    return keyed.join(first, "t").select("text", F.col("w.work_id").alias("work_id"))


def overlay(base: DataFrame, extra: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Base rows and then extra rows of each key, one for each normalised name: the first wins. Both have ord."""
    both = base.withColumn("layer_", F.lit(0)).unionByName(extra.withColumn("layer_", F.lit(1)))
    keyed = both.withColumn("n_", T.normalize_plain(name))
    w = Window.partitionBy(*keys, "n_").orderBy("layer_", "ord")
    return keyed.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("layer_", "n_", "place_")


def audit_rows(materials: DataFrame) -> DataFrame:
    """Materials as the audit reads them: quantity falls back to need, and rows without a name are left out."""
    quantity = F.coalesce(*[F.col(c).cast("double") for c in ("quantity", "need") if c in materials.columns] or [F.lit(None).cast("double")])
    return materials.withColumn("quantity", quantity).where(T.normalize_plain("name") != "")


def resolve_pointers(rows: DataFrame, key: str, pointer: str) -> DataFrame:
    """key, target, hops and state of every row whose pointer may lead to another row.

    state is 'own' without a pointer, 'resolved' (target is the last row of the chain), 'unknown' (the chain ends at a key that no row has)
    or 'cycle'; target is null in these two. Pointers jump over each other, twice as far in every round, so a chain of n links
    takes log2(n) rounds; what still points anywhere after as many rounds as all rows could need runs in a circle. Keys are distinct.
    """
    known = rows.select(F.col(key).alias("id"), F.col(pointer).cast(rows.schema[key].dataType).alias("to"))
    there = known.select(F.col("id").alias("i"), F.col("to").alias("onward"), F.lit(True).alias("is_there"))
    # a link's far end: open (it points on), ended (it is a last row) or lost (there is no such row)
    step = known.where("to is not null").join(there.hint("merge"), F.col("to") == F.col("i"), "left")
    end = F.when(F.col("is_there").isNull(), "lost").when(F.col("onward").isNull(), "ended").otherwise("open")
    links = cut(step.select("id", "to", F.lit(1).cast("bigint").alias("hops"), end.alias("end")), "pointers")
    n = links.count()
    for _ in range(max(n, 1).bit_length()):
        if links.where("end = 'open'").isEmpty():
            break
        far = links.select(F.col("id").alias("i"), F.col("to").alias("t"), F.col("hops").alias("h"), F.col("end").alias("e"))
        moved = links.join(far.hint("merge"), (F.col("to") == F.col("i")) & (F.col("end") == "open"), "left")  # as large as the table: not by way of the driver
        links = cut(moved.select("id", F.coalesce("t", "to").alias("to"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), F.coalesce("e", "end").alias("end")), "pointers")
    found = links.select(F.col("id").alias("i"), "to", "hops", "end")
    out = known.select("id").join(found.hint("merge"), F.col("id") == F.col("i"), "left")
    state = F.when(F.col("end").isNull(), "own").when(F.col("end") == "ended", "resolved").when(F.col("end") == "lost", "unknown").otherwise("cycle")
    target = F.when(state == "own", F.col("id")).when(state == "resolved", F.col("to"))
    return out.select(F.col("id").alias(key), target.alias("target"), F.when(state != "cycle", F.coalesce("hops", F.lit(0))).alias("hops"), state.alias("state"))


def resolve_variants(asked: DataFrame, variants: DataFrame, pointers: DataFrame) -> DataFrame:
    """family, variant, mode and work_id of every distinct asked family and variant.

    variants: family, variant, work_id (a pointer to a work, or null). pointers: work_id, target (see resolve_pointers). mode is 'work'
    (the pointer leads to a work, which stands for the variant), 'overlay' (the family's base with the variant's own rows laid over
    it), 'base' (no variant asked), or null for a family or variant that is not known.
    """
    asks = asked.select("family", "variant").distinct()
    families = variants.select(F.col("family").alias("f_")).distinct()
    told = variants.select(F.col("family").alias("vf_"), F.col("variant").alias("vv_"), F.col("work_id").alias("w_")).withColumn("known_", F.lit(True))
    ends = pointers.select(F.col("work_id").alias("p_"), F.col("target").alias("t_"))
    out = asks.join(families, F.col("family") == F.col("f_"), "left").join(told, (F.col("family") == F.col("vf_")) & (F.col("variant") == F.col("vv_")), "left").join(ends, F.col("w_") == F.col("p_"), "left")
    mode = F.when(F.col("f_").isNull(), None).when(F.col("variant").isNull(), "base").when(F.col("known_").isNull(), None).when(F.col("t_").isNotNull(), "work").otherwise("overlay")
    return out.select("family", "variant", mode.alias("mode"), F.when(mode == "work", F.col("t_")).alias("work_id"))


def variant_rows(asked: DataFrame, variants: DataFrame, pointers: DataFrame, works: DataFrame, base: DataFrame, extra: DataFrame, name: str = "name") -> DataFrame:
    """The rows (resources) of every asked family and variant: those of the work it points to, or the family's base rows with the variant's own after them, one for each name.

    works: work_id, name, ord. base: family, name, ord. extra: family, variant, name, ord. A family or variant that is not known has none.
    """
    found = resolve_variants(asked, variants, pointers)
    told = found.select("family", "variant", "mode", F.col("work_id").alias("w_"))
    pointed = told.where("mode = 'work'").join(works, F.col("w_") == F.col("work_id")).select("family", "variant", name, "ord")
    laid = told.where("mode in ('overlay', 'base')").select("family", "variant")
    own = laid.select("family", "variant").join(base, "family").select("family", "variant", name, "ord")
    more = laid.join(extra, ["family", "variant"]).select("family", "variant", name, "ord")
    return pointed.unionByName(overlay(own, more, ["family", "variant"], name))


def match_resources(expected: DataFrame, present: DataFrame, key: str, order: str | None = "ord", names: str = "names", name: str = "name", by_roots: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Adds matched (the first present name, by order or by itself, that fits the resource or one of its names for the key) and found.

    A name fits that contains one of the resource's names or is contained in it or, with by_roots, shares half the roots of the
    shorter one (texts_match). Empty names fit nothing. by: columns that tell resources of one key and name apart.
    """
    place = F.col(order) if order else F.lit(0)
    mine = expected.select(key, *by, F.col(name).alias("e_"), F.explode(F.array_union(F.array(name), F.col(names))).alias("a_")).withColumn("ask", T.normalize_plain("a_")).where("ask <> ''").select(key, *by, "e_", "ask").distinct()
    mine = cut(mine, "expected")
    theirs = present.select(key, place.alias("o"), F.col(name).alias("n"), T.normalize_plain(name).alias("text")).where("text <> ''").groupBy(key, "text").agg(F.min(F.struct("o", "n")).alias("first"))
    theirs = cut(theirs, "present")
    asks, there = mine.select(key, "ask").distinct(), theirs.select(key, "text")
    inside = matching.contained(there.withColumnRenamed("text", "short"), asks.withColumnRenamed("ask", "long"), [key]).select(key, F.col("long").alias("ask"), F.col("short").alias("text"))
    around = matching.contained(asks.withColumnRenamed("ask", "short"), there.withColumnRenamed("text", "long"), [key]).select(key, F.col("short").alias("ask"), F.col("long").alias("text"))
    fits = inside.unionByName(around).join(theirs, [key, "text"]).select(key, "ask", "first")
    if by_roots:
        rooted = lambda rows, text: rows.withColumn("roots", T.roots(T.tokens_audit(text)))
        fits = fits.unionByName(matching.first_sharing(rooted(asks, "ask"), rooted(theirs, "text"), [key]))
    best = mine.join(fits.groupBy(key, "ask").agg(F.min("first").alias("first")), [key, "ask"]).groupBy(key, *by, F.col("e_").alias(name)).agg(F.min("first").alias("best_"))
    out = expected.join(best, [key, *by, name], "left")
    return out.withColumn("matched", F.col("best_.n")).withColumn("found", F.col("best_").isNotNull()).drop("best_")


def engineering_audit(resources: DataFrame, present: DataFrame, key: str, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """One row per key (and by, columns of the resources): the counts of the completeness audit, matching by names and roots, and its severity.

    resources: key, name, names, kind ('material', with required, or 'typical'). Counts: expected, found, missing, required,
    found_required, missing_required, typical, found_typical, missing_typical and materials.
    """
    there = audit_rows(present)
    seen = match_resources(resources, there, key, order, by=by)
    material, required, typical, found = F.col("kind") == "material", (F.col("kind") == "material") & F.col("required"), F.col("kind") == "typical", F.col("found")
    n = lambda test, name: F.count_if(test).alias(name)
    sums = seen.groupBy(key, *by).agg(
        n(material, "expected"), n(material & found, "found"), n(material & ~found, "missing"), n(required, "required"), n(required & found, "found_required"), n(required & ~found, "missing_required"),
        n(typical, "typical"), n(typical & found, "found_typical"), n(typical & ~found, "missing_typical"),
    )
    out = sums.join(there.groupBy(key).agg(F.count("*").alias("materials")), key, "left").withColumn("materials", F.coalesce("materials", F.lit(0)))
    return out.withColumn("severity", audit_severity(F.col("missing_required"), F.col("missing_typical"), F.col("materials")))


def audit_severity(required_missing: Column, typical_missing: Column, materials: Column) -> Column:
    return F.when(required_missing > 0, "critical").when((typical_missing > 0) | (materials == 0), "warning").otherwise("ok")


def audit(resources: DataFrame, present: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per key (and by, columns of the resources): counts of expected, found and missing resources (required, typical) and severity.

    resources: key, name, names, kind ('material', with required, or 'typical').
    """
    seen = match_resources(resources, present, key, order=None, by_roots=False, by=by)
    lack = lambda kind: F.count_if(kind & ~F.col("found"))
    required, typical = (F.col("kind") == "material") & F.col("required"), F.col("kind") == "typical"
    sums = seen.groupBy(key, *by).agg(F.count_if(F.col("kind") == "material").alias("expected"), F.count_if((F.col("kind") == "material") & F.col("found")).alias("found"), lack(required).alias("missing_required"), lack(typical).alias("missing_typical"))
    n = present.groupBy(key).agg(F.count("*").alias("materials"))
    out = sums.join(n, key, "left").withColumn("materials", F.coalesce("materials", F.lit(0)))
    return out.withColumn("severity", audit_severity(F.col("missing_required"), F.col("missing_typical"), F.col("materials")))


def catalogue_summary(works: DataFrame) -> DataFrame:
    """One row: works, distinct names and works without a name beside their own."""
    return works.agg(F.count("*").alias("works"), F.sum(F.size(F.array_distinct("names"))).alias("names"), F.count_if(F.size("names") < 2).alias("single_named"))


def category_summary(works: DataFrame) -> DataFrame:
    """Works and names of each category."""
    return works.groupBy("category").agg(F.count("*").alias("works"), F.sum(F.size("names")).alias("names"))


def context_profile(context: DataFrame, name: str, variants: Mapping[str, Any], resources: DataFrame, key: str = "family") -> DataFrame:
    """What a quantity search needs to know of a work: family_roots, variant_markers and resource_names. resources: key, name, names."""
    known = resources.groupBy(key).agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.transform(F.concat(F.array("name"), "names"), lambda n: T.normalize_quantity(n)))))).alias("resource_names"))
    roots, marks = F.array().cast("array<string>"), F.array().cast("array<string>")
    for family, spec in variants.items():
        roots = F.when(F.col("family") == family, F.array(*map(F.lit, spec["required"]))).otherwise(roots)
        for variant, markers in spec["variants"].items():
            marks = F.when((F.col("family") == family) & (F.col("variant") == variant), F.array(*[F.lit(m[1]) for m in markers])).otherwise(marks)
    found = classify_taxonomy(context, name, variants).withColumns({"family_roots": roots, "variant_markers": marks})
    return found.join(known, key, "left").withColumn("resource_names", F.coalesce("resource_names", F.array().cast("array<string>")))
