"""What is made once: no expression is repeated by filters, no table is read anew for each count, and equal keys do not pair all with all."""

import pytest
from pyspark.sql import functions as F

from trestle.functions import lexicon as L
from trestle.functions import text as T
from trestle.functions.rows import once
from trestle.operators import approvals, control, documents, intake, planning, quantity, tables, works


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def cells(spark, rows):
    head = [("d", "s", 0, i, v) for i, v in enumerate(["Наименование работ", "Ед. изм.", "Количество", "Начало работ", "Окончание работ"])]
    body = [("d", "s", r, i, v) for r, name in enumerate(rows, 1) for i, v in enumerate([name, "шт", str(r), "01.02.2024", "2024-03-01"])]
    return spark.createDataFrame(head + body, "doc string, sheet string, row_idx int, col_idx int, value string")


def test_a_filter_reads_what_was_made(spark):
    rows = once(spark.range(200), x=F.rand(7)).where("x < 0.5")
    assert plan(rows).count("rand(") == 1
    assert all(r.x < 0.5 for r in rows.collect())


def test_stem_is_the_pattern(spark):
    words = ["кабельными", "труба", "дома", "моя", "ями", "кабель", "иями", "работами", "абвгая", "абвгиями", "", "a", "шкафом", "ящикиями", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select(T.stem(F.col("w")).alias("a"), F.regexp_replace("w", T.STEM_PATTERN, "$1").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_first_phrase_that_starts_a_text(spark):
    phrases = ["итого по разделу", "Итого ", "в т. ч.", "счёт–фактура"]
    rows = spark.createDataFrame([(t,) for t in ["итого по разделу 1", "итого", "в т ч песок", "счет-фактура 3", "прочее", "", None]], "t string")
    assert [r[0] for r in rows.select(T.starts_with_any(F.col("t"), phrases)).collect()] == ["итого по разделу", "Итого ", "в т. ч.", "счёт–фактура", None, None, None]
    assert [T.table_form(p) for p in phrases] == list(spark.range(1).select(*[T.normalize_table(F.lit(p)) for p in phrases]).first())


def test_row_types_normalise_once(spark):
    rows = spark.createDataFrame([("Монтаж 1",), ("Прочее",)], "value string")
    typed = tables.with_row_type(rows, "value").where("row_type = 'uncertain'")
    assert [r.value for r in typed.collect()] == ["Прочее"]
    assert plan(typed).count("translate(") == 2  # the two of one normalize_table()


def test_sheets_send_headers_not_cells(spark):
    rows = tables.analyze_sheets(cells(spark, ["Монтаж опоры", "Прочее"]))
    assert {(r.row_idx, r.row_type) for r in rows.collect()} == {(1, "work"), (2, "work")}
    assert "rightHint=(strategy=broadcast)" in plan(rows) and "RepartitionByExpression" in plan(rows)


def test_uncertain_groups_rank_before_the_shuffle(spark):
    rows = spark.createDataFrame([(d, f"n{i}", i, "uncertain" if i % 2 else "work") for d in ("a", None) for i in range(9)], "doc string, name string, i int, row_type string")
    found = tables.uncertain_groups(rows, "doc", "name", ["i"])
    assert {(r.doc, r.n, tuple(r.examples)) for r in found.collect()} == {("a", 4, ("n1", "n3", "n5")), (None, 4, ("n1", "n3", "n5"))}
    assert "WindowGroupLimit" in plan(found)


def test_a_package_reads_its_rows_once(spark):
    books = intake.analyze_books(cells(spark, ["Монтаж опоры", "Песок", "Кран"]))
    assert books["rows"].inputFiles()
    pages = spark.createDataFrame([("p", 1, "Пояснительная записка. До начала работ необходимо согласовать с РЖД производство работ.")], "doc string, page bigint, text string")
    told = intake.analyze_pages(pages)
    assert told["documents"].inputFiles() and told["approvals"].inputFiles()


def test_documents_count_each_phrase_once(spark):
    pages = spark.createDataFrame([("d", 1, "Календарный график. Начало работ, начало работ")], "doc string, page int, text string")
    found = documents.classify_documents(pages)
    assert found.select("kind", "score", "phrases").first()[:] == ("schedule", 13, ["календарный график", "начало работ"])
    assert plan(found).count("transform(") == 1 + 4  # of the pages' texts, and of the phrases


def test_material_rows_are_matched_once(spark):
    pages = spark.createDataFrame([("d", 1, "Спецификация материалов\n1 Кабель ВВГнг 3х2,5 м 12\n2 Муфта шт 3")], "doc string, page int, text string")
    found = documents.extract_materials(pages)
    assert {(r.name, r.quantity, r.unit) for r in found.collect()} == {("Кабель ВВГнг 3х2,5", 12.0, "м"), ("Муфта", 3.0, "шт")}
    assert plan(found).count("regexp_extract(") == 3


def test_quantities_are_parsed_once(spark):
    pages = spark.createDataFrame([("d", 1, "труба 12,5 м и 3 шт")], "doc string, page int, text string")
    found = quantity.extract_quantities(pages)
    assert {(r.quantity, r.unit) for r in found.collect()} == {(12.5, "м"), (3.0, "шт")}
    assert plan(found).count("regexp_extract(") == 2


def test_intents_are_told_once(spark):
    pages = spark.createDataFrame([("d", 1, "До начала работ необходимо согласовать с РЖД производство работ.")], "doc string, page bigint, text string")
    found = approvals.extract_approvals(pages)
    assert [r.intent for r in found.collect()] == ["prerequisite"]
    assert plan(found).count(L.APPROVAL_INTENTS[1][0]) == 1


def test_totals_and_plans_never_pair_contexts_with_materials(spark, monkeypatch):
    state = control.material_state(spark.createDataFrame([("P", "O", "W", i, f"труба {i}", float(i), 1.0) for i in range(4)], "project string, object string, work string, ord int, name string, need double, stock double").withColumns({"reserved": F.lit(0.0), "confirmed": F.lit(0.0)}))
    contexts = spark.createDataFrame([(i, "p", "o ", "w", i, "k", "taxonomy" if i % 2 else "matcher", "f", "v", None, None) for i in range(6)], "context_id int, project string, object string, work string, ord int, work_id string, work_source string, family_id string, variant_id string, manual_quantity double, document_quantity double")
    assert {tuple(r) for r in control.context_totals(state, contexts, n=F.count("*"), need=F.sum("need")).collect()} == {(i, 4, 6.0) for i in range(6)}
    resources = spark.createDataFrame([("k", "труба", ["труба"], "material", True), ("k", "люк", ["люк"], "typical", False)], "work_id string, name string, names array<string>, kind string, required boolean")
    rules = spark.createDataFrame([("r", "k", None, None, "per-item", 2.0, 1.0, 0.0, 1.0)], "rule_id string, work_id string, family_id string, variant_id string, calculation string, rate double, quantity double, reserve_percent double, rounding double")
    monkeypatch.setattr(control, "context_materials", lambda *_: pytest.fail("pairs"))
    got = planning.report(contexts, state, resources, rules).select("context_id", "materials", "deficits", "deficit", "work_quantity", "missing_required", "missing_typical", "rules", "level").collect()
    assert {tuple(r) for r in got} == {(i, 4, 2, 3.0, 3.0, 0, 1, 1, "high") for i in range(6)}


def test_rules_are_told_apart_before_contexts_get_them(spark):
    contexts = spark.createDataFrame([(1, "k", "f", None), (2, "k", "f", None), (3, None, "f", "v"), (4, None, None, None)], "context_id int, work_id string, family_id string, variant_id string")
    rules = spark.createDataFrame([("a", "k", None, None), ("a", None, "f", None), ("b", None, "f", "v")], "rule_id string, work_id string, family_id string, variant_id string")
    found = planning.rules_for_contexts(contexts, rules)
    assert sorted((r.context_id, r.rule_id) for r in found.collect()) == [(1, "a"), (2, "a"), (3, "a"), (3, "b")]
    assert "first(context_id" not in plan(found) and "Aggregate [context_id" not in plan(found)


def test_pointers_do_not_go_by_the_driver(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "k int, p int")
    found = works.resolve_pointers(rows, "k", "p")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0, "own"), (2, 1, 1, "resolved"), (3, 1, 2, "resolved"), (4, None, 1, "unknown")}
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_quantity_windows_are_cut_out_of_pages_made_normal_once(spark):
    texts = ["Подземная  «кабельная»\tканализация – 12,5 м; муфта 3 шт. ", "ΑΣ Кабельная (канализация) 7 м", "İ кабельная\nканализация ё 7 м, всего 1 000 м", "x" * 300 + " кабельная канализация 5 м " + "é" * 200 + "Σ 6 м"]
    pages = spark.createDataFrame([(i, 1, t, 100) for i, t in enumerate(texts)], "doc int, page int, text string, priority int")
    profile = quantity.prepare_profile(spark.createDataFrame([("Подземная кабельная канализация", ["кабельн", "канализац"], ["подземная"], ["муфта"])], "work_name string, family_roots array<string>, variant_markers array<string>, resource_names array<string>"))
    plain = quantity.score_quantities(quantity.extract_quantities(pages).crossJoin(profile))
    made = quantity.score_quantities(quantity.extract_quantities(once(pages, normal=T.quantity_chars("text"))).crossJoin(profile), normal="normal")
    columns = ["doc", "index", "raw", "unit", "evidence", "score", "eligible", "kind"]
    assert sorted(map(str, made.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert [r[0] is None for r in pages.orderBy("doc").select(T.quantity_chars("text")).collect()] == [False, True, True, True]
    assert plan(made.select("score")).count("split(") == 0  # words are found, texts are not split at all that parts them


def test_words_of_running_text(spark):
    rows = spark.createDataFrame([("Кабельная-трасса, устройство; ab abc é-1x 😀абв№12",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.tokens_quantity("t")).collect()] == [["кабельная-трасса", "abc", "-1x", "абв"], [], []]


def test_bounded_words_are_looked_for_by_their_letters(spark):
    plain = [r"(^|[^а-яa-z0-9])кп([^а-яa-z0-9]|$)", r"(^|[^а-яa-z0-9])дс\s*№?", r"(^|\s)изм\.?($|\s)", r"(^|[^а-яa-z0-9])спецификац[а-яё]*", r"(^|[^ab])xy*|z", r"(^|[^ab])(x)", r"(^|[^ab])xyz?"]
    assert [p != T.by_letters(p) for p in plain] == [True, True, True, True, False, False, True]
    texts = ["кп", "скп", "с кп", "скп кп", "кпс", "ТЗ,кп.", "кп\n", "\nкп", "кпкп", "производство", "дс №1", "адс дс", "😀кп😀", "изм", "изм.", "низм изм", "изм.\n", "и изм .", "спецификация", "аспецификац", "", "z", "ax", "cx", "x", "axy", "cxy", "axz", "xyz bxyz", "ё кп", "ёкп"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in plain:
        assert rows.where(F.regexp_like("t", F.lit(p)) != F.regexp_like("t", F.lit(T.by_letters(p)))).count() == 0, p


def test_signals_are_counted_once(spark):
    rows = spark.createDataFrame([("a.pdf", "коммерческое предложение"), ("a.pdf", "x " * 1000 + "коммерческое предложение"), ("кп 1.pdf", ""), ("a", None)], "name string, t string")
    signals = {"commercial-proposal": L.SIGNALS["commercial-proposal"], "estimate": L.SIGNALS["estimate"]}
    found = documents.classify_signals(rows, "name", "t", signals)
    assert [tuple(r)[2:] for r in found.collect()] == [("commercial-proposal", "high", 20, False), ("commercial-proposal", "medium", 6, False), ("commercial-proposal", "high", 12, True), (None, None, 0, False)]
    assert plan(found).count(L.SIGNALS["estimate"]["strong"][0]) == 3  # file name, text and, if that is long, its lead
