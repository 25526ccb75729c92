"""The keyword command language: one of five reports over the materials, chosen by the first keyword group that a command holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.operators.control import material_state

#: Report and the words that call for it, in order of precedence. Fixed values.
COMMANDS = (
    ("summary", ("сводка", "сводку", "итог", "общая информация")),
    ("context", ("проект", "объект", "работа")),
    ("deficit", ("дефицит", "не хватает", "риск")),
    ("list", ("все материалы", "покажи материалы", "список материалов")),
    ("responsible", ("ответственный", "кто отвечает", "ответственные")),
    ("help", ("помощь", "что умеешь", "команды")),
)
UNASSIGNED = "Не назначен"


def report_of(command: str) -> str:
    text = command.strip().lower()
    return next((name for name, words in COMMANDS if any(w in text for w in words)), "unknown")


def summary(materials: DataFrame) -> DataFrame:
    """One row: materials, with_deficit, without_responsible and the name and size of the largest deficit, the first of equals by ord."""
    state = material_state(materials)
    nobody = F.col("responsible").isNull() | F.col("responsible").isin("", UNASSIGNED)
    worst = F.min(F.when(F.col("deficit") > 0, F.struct((-F.col("deficit")).alias("negative"), "ord", "name")))
    out = state.agg(F.count("*").alias("materials"), F.count_if(F.col("deficit") > 0).alias("with_deficit"), F.count_if(nobody).alias("without_responsible"), worst.alias("w"))
    return out.select("materials", "with_deficit", "without_responsible", F.col("w.name").alias("largest_name"), (-F.col("w.negative")).alias("largest_deficit"))


def ask(materials: DataFrame, command: str) -> DataFrame:
    """The report's rows; an empty command, help or an unknown command gives no rows."""
    text, report = command.strip().lower(), report_of(command)
    if report == "summary":
        return summary(materials)
    state = material_state(materials)
    if report == "context":
        held = F.lit(False)
        for c in ("project", "object", "work"):
            v = F.lower(F.coalesce(c, F.lit("")))
            held = held | ((v != "") & F.contains(F.lit(text), v))
        return state.where(held)
    if report == "deficit":
        return state.where("deficit > 0")
    if report == "list":
        return state
    if report == "responsible":
        return state.select("project", "object", "work", "name", F.coalesce("responsible", F.lit("ответственный не назначен")).alias("responsible"))
    return state.where("false")
