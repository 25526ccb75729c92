"""Operators on small hand-made tables, with the boundaries of their thresholds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trestle.operators import approvals, ask, control, documents, history, planning, quantity, registry, tables, works

PAGES = [
    ("d1", 1, "Ведомость объемов работ. Прокладка кабельной канализации на эстакаде: общая длина трассы 5 420,5 м. Всего 12 компл. муфт и 3 шт."),
    ("d1", 2, "Кабельная канализация подземная, траншея 120 м2; итого 340 м. Труба ПНД 110 мм 25 м, 25 м"),
    ("d2", 1, "Пояснительная записка. До начала работ необходимо согласовать с РЖД производство работ. Уведомить заказчика о начале работ за 5 дней!"),
    ("d2", 2, "До начала работ необходимо согласовать с РЖД производство работ. Изм. Кол.уч Лист №док Подп. Дата согласовано"),
    ("d3", 1, "Спецификация оборудования, изделий и материалов\n1 Кабель ВВГнг 3х2,5 м 120\n2 Монтаж опоры шт 4\n3 Шкаф управления ШУ-10 шт 2\n3 Шкаф управления ШУ-10 шт 2\nИтого 10"),
]

D = datetime.date


def material_rows(spark, rows):
    schema = "name string, need double, stock double, reserved double, confirmed double, delivery date, lead_days int, need_date date, project string, object string, work string, responsible string, ord int"
    full = [(f"m{i}", *r, "Проект", "Объект", "Работа", None if i else "Иванов", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_risk_levels(spark):
    need = D(2026, 8, 10)
    rows = [
        (10.0, 10.0, 0.0, 0.0, None, 1, None),
        (10.0, 5.0, 0.0, 0.0, None, 1, need),
        (10.0, 5.0, 0.0, 5.0, D(2026, 8, 11), 1, need),
        (10.0, 10.0, 0.0, 0.0, None, 30, need),
        (10.0, 10.0, 0.0, 0.0, None, 1, need),
        (10.0, 12.0, 3.0, 1.0, need, 30, need),
    ]
    out = control.with_risk(control.material_state(material_rows(spark, rows)), F.lit(D(2026, 8, 1))).orderBy("ord").collect()
    assert [r["risk"] for r in out] == ["critical", "critical", "critical", "warning", "ok", "ok"]


def test_categories_can_meet_and_order_is_never_primary(spark):
    rows = [(10.0, 20.0, 0.0, 0.0, None, 1, None), (10.0, 0.0, 0.0, 4.0, D(2026, 7, 1), 1, D(2026, 8, 1)), (10.0, 0.0, 0.0, 20.0, D(2026, 8, 1), 1, D(2026, 9, 1))]
    out = control.with_categories(control.material_state(material_rows(spark, rows)), F.lit(D(2026, 7, 15))).orderBy("ord").collect()
    assert out[0]["categories"] == ["critical", "ok"] and out[0]["primary"] == "critical"
    assert out[1]["categories"] == ["critical", "order", "low-stock", "delayed"] and out[1]["primary"] == "delayed"
    assert out[2]["categories"] == ["low-stock", "expected"] and out[2]["primary"] == "low-stock"


def test_schedule_lookup_keeps_first_context_and_does_not_fold_letters(spark):
    m = material_rows(spark, [(1.0, 0.0, 0.0, 0.0, None, 1, None)]).drop("need_date")
    contexts = [(" ПРОЕКТ", "объект ", "РАБОТА", D(2026, 8, 12), 2, 5), ("проект", "объект", "работа", D(2026, 1, 1), 0, 9)]
    c = spark.createDataFrame(contexts, "project string, object string, work string, start date, safety_days int, ord int")
    assert control.with_schedule(m, c).first()["need_date"] == D(2026, 8, 10)
    folded = c.withColumn("project", F.lit("проёкт"))
    assert control.with_schedule(m.withColumn("project", F.lit("проект")), folded).first()["need_date"] is None


def test_lifecycle_scenario(spark):
    """Create, update, archive, restore, archive again: revisions 1 to 5; actions from a wrong state are turned away."""
    acts = ["create", "update", "archive", "restore", "archive", "update", "create"]
    rows = spark.createDataFrame([("m", i, a) for i, a in enumerate(acts)], "key string, seq int, action string")
    assert history.replay(rows, "key", ["seq"]).first().asDict() == {"key": "m", "status": "archived", "revision": 5, "rejected": 2}


def test_history_diff_shows_before_and_after(spark):
    rows = spark.createDataFrame([("m", 1, "2000", "шт"), ("m", 2, "2200", "шт")], "key string, seq int, need string, unit string")
    out = history.with_before(rows, "key", ["seq"], ["need", "unit"]).select(history.describe_changes([("need", "Потребность"), ("unit", "Единица")]).alias("d"), "seq").orderBy("seq").collect()
    assert [r["d"] for r in out] == ["Потребность: — → 2000; Единица: — → шт", "Потребность: 2000 → 2200"]


def test_promotion_supersedes(spark):
    rows = spark.createDataFrame([("d", 1, True), ("d", 2, True), ("d", 3, False), ("e", 1, False)], "document string, n int, ok boolean")
    out = registry.promote(rows, "document", F.col("ok"), ["n"]).orderBy("document", "n").collect()
    assert [r["status"] for r in out] == ["superseded", "current", "received", "received"]
    best = registry.effective(registry.promote(rows, "document", F.col("ok"), ["n"]), "document", "n", "n").orderBy("document").collect()
    assert [(r["document"], r["n"]) for r in best] == [("d", 2), ("e", 1)]


@pytest.mark.parametrize(
    ("name", "kind"), [("ВОР-1.xlsx", "work-volume"), ("ГПР.xlsx", "schedule"), ("доп соглашение.pdf", "agreement"), ("наше кп 3.pdf", "commercial-proposal"), ("смета.xls", "estimate"), ("раздел.pdf", "project-documentation"), ("x.csv", "other")]
)
def test_kind_from_file_name(spark, name, kind):
    assert spark.range(1).select(registry.guess_kind(F.lit(name), F.lit(None).cast("string")).alias("k")).first()["k"] == kind


def test_matcher(spark):
    catalogue = spark.createDataFrame([("cable", 0, ["Прокладка кабеля"]), ("duct", 1, ["Подземная кабельная канализация"])], "work_id string, ord int, names array<string>")
    queries = spark.createDataFrame([("прокладка подземной кабельной канализации",), ("окраска",), ("",)], "q string")
    out = {r["name"]: r for r in works.match_works(queries, "q", catalogue).collect()}
    top = out["прокладка подземной кабельной канализации"]
    assert (top["work_id"], top["score"], top["confidence"]) == ("cable", 92, "high")  # a tie: the earlier work wins
    assert [(a["work_id"], a["score"]) for a in top["alternatives"]] == [("duct", 92)]
    assert out["окраска"]["work_id"] is None and out[""]["score"] == 0


def test_taxonomy_gap(spark):
    rules = {"f": {"required": ["кабельн"], "variants": {"a": [("root", "подземн", 90)], "b": [("root", "надземн", 76)], "c": [("root", "мост", 75)]}}}
    rows = spark.createDataFrame([("кабельный подземный надземный",), ("кабельный подземный мост",)], "n string")
    out = [r["decision"] for r in works.classify_taxonomy(rows, "n", rules).collect()]
    assert out == ["variant-ambiguous", "family-and-variant-detected"]  # gaps of 14 and 15


def test_rules(spark):
    rows = [("per-length", 1.0, None, 5.0, 10.0, 100.0), ("per-item", 4.0, None, 10.0, 10.0, 25.0), ("fixed-per-work", None, 2.0, None, None, None), ("per-length", 1.0, None, None, None, None), ("odd", None, None, None, None, 1.0)]
    frame = spark.createDataFrame(rows, "calculation string, rate double, quantity double, reserve_percent double, rounding double, work_quantity double")
    out = planning.calculate(frame).collect()
    assert [r["calculated_quantity"] for r in out] == [110.0, 120.0, 2.0, None, None]
    assert [r["error"] for r in out] == [None, None, None, "WORK_QUANTITY_REQUIRED", "UNKNOWN_CALCULATION_TYPE"]


def test_audit_severity(spark):
    level = lambda *n: spark.range(1).select(works.audit_severity(*map(F.lit, n)).alias("s")).first()["s"]
    assert [level(1, 0, 3), level(0, 1, 3), level(0, 0, 0), level(0, 0, 1)] == ["critical", "warning", "warning", "ok"]


def grid(spark, rows, doc="книга"):
    cells = [(doc, "лист", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None]
    return spark.createDataFrame(cells, "doc string, sheet string, row_idx int, col_idx int, value string")


def test_header_and_rows(spark):
    cells = grid(spark, [["Ведомость объемов работ"], ["Наименование работ", "Ед. изм.", "Количество"], ["Монтаж опоры", "шт.", "4"], ["Песок", "м3", "1 200,5"], ["Итого по разделу", "шт", "1"], ["Кран 25т", "шт", "1"], ["Установка буровая", "шт", "1"], ["ab", "шт", "1"], ["Без объёма", "шт", "0"]])
    head = tables.find_headers(cells, tables.classify_tables(cells)).first()
    assert (head["header_row"], head["header_score"], head["header_confidence"], head["work_col"], head["unit_col"], head["quantity_col"]) == (1, 15, "high", 0, 1, 2)
    out = {r["work_name"]: r for r in tables.analyze_sheets(cells).collect()}
    assert {k: v["row_type"] for k, v in out.items()} == {"Монтаж опоры": "work", "Песок": "material", "Итого по разделу": "summary", "Кран 25т": "machinery", "Установка буровая": "machinery"}
    assert out["Песок"]["quantity"] == 1200.5 and out["Песок"]["unit"] == "м³"
    assert [k for k, v in out.items() if v["automatic"]] == ["Монтаж опоры"]


def test_generic_name_header_needs_a_work_table(spark):
    plain = grid(spark, [["Наименование", "Ед. изм.", "Количество"], ["Кабель", "м", "5"]])
    assert tables.find_headers(plain, tables.classify_tables(plain)).count() == 0
    known = grid(spark, [["Ведомость работ"], ["Наименование", "Ед. изм.", "Количество"], ["Кабель", "м", "5"]])
    assert tables.find_headers(known, tables.classify_tables(known)).first()["header_row"] == 1


def test_schedule_review_boundaries(spark):
    dates = [(D(2026, 1, 1), D(2026, 6, 29)), (D(2026, 1, 1), D(2026, 6, 30)), (D(2026, 1, 1), None), (D(2026, 1, 2), D(2026, 1, 1))]
    rows = spark.createDataFrame(dates, "a date, b date").select(tables.schedule_review(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in rows] == [[], ["long"], ["one-date"], ["order"]]  # 180 and 181 days


def test_document_kinds_and_fusion(spark):
    fuse = lambda *v: tuple(spark.range(1).select(*[c.alias(k) for k, c in documents.fuse_kinds(*[F.lit(x).cast("string") for x in v]).items()]).first())
    assert fuse("schedule", "high", "schedule", "low") == ("schedule", "high", False)
    assert fuse("schedule", "medium", "estimate", "high") == ("estimate", "medium", True)
    assert fuse("schedule", "high", "estimate", "high") == ("schedule", "medium", True)
    assert fuse(None, None, "unknown", "low") == ("other", "low", False)


def pages(spark):
    return spark.createDataFrame(PAGES, "doc string, page bigint, text string")


def test_quantities_have_offsets(spark):
    got = quantity.extract_quantities(pages(spark).where("doc = 'd1' and page = 2")).orderBy("index").collect()
    assert [(r["raw"], r["quantity"], r["unit"]) for r in got] == [("120 м2", 120.0, "м²"), ("340 м", 340.0, "м"), ("25 м", 25.0, "м"), ("25 м", 25.0, "м")]
    text = PAGES[1][2]
    assert all(text[r["index"] : r["index"] + len(r["raw"])] == r["raw"] for r in got)


def test_materials_in_pages(spark):
    got = documents.extract_materials(pages(spark)).collect()
    assert sorted((r["name"], r["quantity"], r["unit"]) for r in got) == [("Кабель ВВГнг 3х2,5", 120.0, "м"), ("Шкаф управления ШУ-10", 2.0, "шт")]


def test_approvals_group_across_pages(spark):
    found = approvals.group_approvals(approvals.extract_approvals(pages(spark)))
    first = found.where("intent = 'prerequisite'").first()
    assert (first["organization"], first["page"], first["pages"], first["occurrences"]) == ("РЖД", 1, 2, 2)


def plain_groups(rows, near=140):
    """Founders and their members by one fold over a document's approvals in order of reading."""
    groups = []
    for page, index, signature in sorted(rows):
        fit = next((g for g in groups if g[0][2] == signature or (g[0][0] == page and abs(g[0][1] - index) <= near)), None)
        if fit is None:
            groups.append([(page, index, signature)])
        else:
            fit.append((page, index, signature))
    return sorted((g[0][0], g[0][1], len({p for p, _, _ in g}), len(g)) for g in groups)


@pytest.mark.parametrize("seed", range(4))
def test_approvals_equal_the_fold(spark, seed):
    """Chains of nearness and signatures over pages: the rounds end where one fold over the whole document ends."""
    rng = random.Random(seed)
    rows = sorted({(rng.randint(1, 12), rng.randint(0, 40) * 35): rng.choice("abcdefghijkl") for _ in range(70)}.items())
    found = [("d", "t", None if d else "o", "i", p, i, s, f"{p}/{i}") for d in (0, 1) for (p, i), s in rows]
    frame = spark.createDataFrame(found, "doc string, type string, organization string, intent string, page bigint, index int, signature string, context string")
    got = approvals.group_approvals(frame).collect()
    plain = plain_groups([(p, i, s) for (p, i), s in rows])
    for org in ("o", None):
        assert sorted((r["page"], r["index"], r["pages"], r["occurrences"]) for r in got if r["organization"] == org) == plain
    assert all(r["context"] == f"{r['page']}/{r['index']}" for r in got)


def test_approvals_near_the_founder(spark):
    base = ("d", "approval", "РЖД", "action")
    rows = [(*base, 1, 0, "a", "c"), (*base, 1, 140, "b", "c"), (*base, 1, 141, "c", "c")]
    frame = spark.createDataFrame(rows, "doc string, type string, organization string, intent string, page bigint, index int, signature string, context string")
    assert sorted(r["occurrences"] for r in approvals.group_approvals(frame).collect()) == [1, 2]


def test_commands_are_dispatched_in_order(spark):
    assert [ask.report_of(c) for c in ("Сводка по проекту", "дефицит по проекту", "где риск", "все материалы", "кто отвечает", "помощь", "привет")] == ["summary", "context", "deficit", "list", "responsible", "help", "unknown"]
    m = material_rows(spark, [(5.0, 1.0, 0.0, 0.0, None, 1, None), (9.0, 5.0, 0.0, 0.0, None, 1, None)])
    assert ask.ask(m, "сводка").first().asDict() == {"materials": 2, "with_deficit": 2, "without_responsible": 1, "largest_name": "m0", "largest_deficit": 4.0}


def test_history_sentences(spark):
    rows = [(1, "create", 5, "шт", 1), (2, "update", 6, "шт", 1), (3, "update", 6, "шт", 1), (4, "archive", 6, "шт", 1), (5, "restore", 6, None, 1), (6, "odd", 6, "м", 2)]
    frame = spark.createDataFrame([("k", *r) for r in rows], "key string, seq int, action string, need int, unit string, lead_days int")
    fields = [("need", "Потребность"), ("unit", "Единица"), ("lead_days", "Срок поставки")]
    seen = history.with_before(frame, "key", ["seq"], [f for f, _ in fields])
    got = [tuple(r) for r in seen.orderBy("seq").select(history.action_label(F.col("action")), history.describe_event(F.col("action"), fields)).collect()]
    assert got == [
        ("Добавлено", "Создана позиция: 5 шт."), ("Изменено", "Потребность: 5 → 6"), ("Изменено", "Сохранение без изменения контролируемых полей."),
        ("Исключено", "Позиция исключена из активного расчёта. Предыдущие данные сохранены."), ("Восстановлено", "Позиция восстановлена в активный расчёт."), ("Изменено", "Единица: — → м; Срок поставки: 1 → 2"),
    ]
