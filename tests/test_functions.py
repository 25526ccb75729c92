"""Hand-derived values of the text and value functions."""

import datetime

from pyspark.sql import functions as F

from trestle.functions import parse as P
from trestle.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def test_normalisers(spark):
    raw = lit(" «Ёлка»,  Бетон-М300 – (плита): 1.5 м ")
    assert one(spark, T.normalize_work(raw)) == "елка бетон м300 плита 1 5 м"
    assert one(spark, T.normalize_table(raw)) == "елка бетон-м300 - плита 1 5 м"
    assert one(spark, T.normalize_quantity(raw)) == "елка , бетон-м300 - плита : 1.5 м"
    assert one(spark, T.normalize_plain(raw)) == "«елка», бетон-м300 – (плита): 1.5 м"
    assert one(spark, T.normalize_key(lit("  Ёлка  А "))) == "ёлка  а"
    assert one(spark, T.normalize_work(lit(None).cast("string"))) == ""


def test_tokens_and_stems(spark):
    assert one(spark, T.tokens_work(lit("Монтаж опор и лотков на мосту"))) == ["монтаж", "опор", "лотков", "мосту"]
    assert one(spark, T.tokens_table(lit("Устройство кабельной канализации, 5 шт"))) == ["кабельной", "канализации"]
    words = ["канализациями", "опора", "кран", "подземная", "столы", "тело"]
    assert [one(spark, T.stem(lit(w))) for w in words] == ["канализац", "опор", "кран", "подземн", "стол", "тело"]


def test_matching(spark):
    assert one(spark, T.roots_match(lit("кабел"), lit("кабельн")))
    assert not one(spark, T.roots_match(lit("каб"), lit("кабельн")))
    assert one(spark, T.texts_match(lit("Труба ПНД 110"), lit("труба")))
    assert not one(spark, T.texts_match(lit(""), lit("труба")))
    wanted, there = F.array(*map(F.lit, ["кабельн", "канализац", "кабельн"])), F.array(lit("канализац"))
    assert one(spark, T.coverage(wanted, there)) == 0.5
    assert one(spark, T.phrase_count(lit("аааа"), "аа")) == 2


def test_prefix_phrases_lose_their_space(spark):
    row = spark.createDataFrame([("блокировка",), ("блок фбс",), ("песчаник",)], "t string")
    got = row.select(T.starts_with_any(F.col("t"), ["блок ", "песок "]).alias("x")).collect()
    assert [r["x"] for r in got] == ["блок ", "блок ", None]


def test_revision_labels(spark):
    cases = {"revA": False, "rev.b": True, "rev1": False, "Rev 2": True, "R1": False, "r3": True, "изм.1": True, "изм 2": True, "": False, None: False}
    for label, expected in cases.items():
        assert one(spark, T.is_followup_revision(lit(label).cast("string"))) is expected, label


def test_sentence_and_window(spark):
    text = "Первое. До начала работ согласовать с РЖД! Третье"
    at = text.index("согласовать")
    assert one(spark, T.sentence_around(lit(text), lit(at), lit(11))) == "До начала работ согласовать с РЖД!"
    assert one(spark, T.sentence_around(lit("да. нет. ок"), lit(4), lit(3))) == "да. нет. ок"
    assert one(spark, T.window_around(lit("abcdefghij"), lit(5), 2, 3)) == "defgh"


def test_numbers(spark):
    got = {x: one(spark, P.parse_number(lit(x))) for x in ("1 234,5", "+7", "1,2,3", "5 шт", "", "-0.5", "1e3")}
    assert got == {"1 234,5": 1234.5, "+7": 7.0, "1,2,3": None, "5 шт": None, "": None, "-0.5": -0.5, "1e3": None}
    assert one(spark, P.parse_loose_number(lit(""))) == 0.0
    assert one(spark, P.parse_loose_number(lit("1e3"))) == 1000.0


def test_rounding_up_works_on_doubles(spark):
    assert one(spark, P.ceil_to_step(lit(25.0) * 4 * (1 + lit(10.0) / 100), 10.0)) == 120.0
    assert one(spark, P.ceil_to_step(lit(100.0) * 1.05, 10.0)) == 110.0
    assert one(spark, P.ceil_to_step(lit(2.2))) == 3.0


def test_units(spark):
    assert one(spark, P.quantity_unit(lit("компл."))) == "м"
    assert one(spark, P.table_unit(lit("компл."))) == "компл."
    assert one(spark, P.table_unit(lit("вёдра"))) == ""
    assert one(spark, P.material_unit(lit("Рулон"))) == "рул."


def test_dates_and_durations(spark):
    got = {x: one(spark, P.parse_date_text(lit(x))) for x in ("01.02.26", "45000", "2026-3-5", "1.12.2025 г.", "31.02.2026", "завтра")}
    assert got == {"01.02.26": "2026-02-01", "45000": "2023-03-15", "2026-3-5": "2026-03-05", "1.12.2025 г.": "2025-12-01", "31.02.2026": "2026-02-31", "завтра": None}
    assert one(spark, P.parse_date(lit("31.02.2026"))) is None
    day = lambda s: F.lit(datetime.date.fromisoformat(s))
    assert one(spark, P.duration_days(day("2026-08-01"), day("2026-08-13"))) == 13
    assert one(spark, P.duration_days(day("2026-08-02"), day("2026-08-01"))) is None


def test_file_facts(spark):
    assert [one(spark, P.extension(lit(n))) for n in ("a.PDF", "noext", "x.tar.gz")] == ["pdf", "", "gz"]
    assert one(spark, T.plural_documents(lit(21))) == "21 документ"
    assert one(spark, T.plural_documents(lit(12))) == "12 документов"
    assert one(spark, T.plural_documents(lit(3))) == "3 документа"
