"""The text functions for SQL text: temporary SQL functions of a session, which Spark inlines into the plan.

register(spark) makes them; spark.sql() and views can then call them by name. Each equals the Column function of the same
name in trestle.functions.text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from trestle.functions import lexicon as L
from trestle.functions.text import STEM_PATTERN


def _literal(text: str) -> str:
    return "r'" + text + "'"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_COLLAPSED = r"trim(regexp_replace({0}, r'(?U)[\s﻿]+', ' '))"
_LOWER = "translate(lower(coalesce(t, '')), 'ё', 'е')"
_MATCH = "(a = b OR (length(a) >= 4 AND length(b) >= 4 AND (startswith(a, b) OR startswith(b, a))))"

#: Name, parameters, type and body.
FUNCTIONS = (
    ("normalize_work", "t STRING", "STRING", _COLLAPSED.format(f"regexp_replace({_LOWER}, \"[«»\\\"'().,;:–—-]\", ' ')")),
    ("normalize_plain", "t STRING", "STRING", _COLLAPSED.format(_LOWER)),
    ("stem", "w STRING", "STRING", f"regexp_replace(w, {_literal(STEM_PATTERN)}, '$1')"),
    ("tokens_work", "t STRING", "ARRAY<STRING>", f"filter(split(trestle_normalize_work(t), ' '), w -> length(w) >= 2 AND w NOT IN ({_list(L.STOP_WORK)}))"),
    ("tokens_audit", "t STRING", "ARRAY<STRING>", f"filter(split(trestle_normalize_plain(t), ' '), w -> length(w) >= 2 AND w NOT IN ({_list(L.STOP_AUDIT)}))"),
    ("roots", "words ARRAY<STRING>", "ARRAY<STRING>", f"transform(words, w -> regexp_replace(w, {_literal(STEM_PATTERN)}, '$1'))"),
    ("roots_match", "a STRING, b STRING", "BOOLEAN", _MATCH),
    ("matched_roots", "wanted ARRAY<STRING>, there ARRAY<STRING>", "ARRAY<STRING>", f"filter(wanted, a -> exists(there, b -> {_MATCH}))"),
    ("coverage", "wanted ARRAY<STRING>, there ARRAY<STRING>", "DOUBLE", f"CASE WHEN size(array_distinct(wanted)) = 0 THEN 0D ELSE size(filter(array_distinct(wanted), a -> exists(there, b -> {_MATCH}))) / size(array_distinct(wanted)) END"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions in the session, each as trestle_<name>; returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trestle_{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f"trestle_{f[0]}" for f in FUNCTIONS]
