"""Columns, and values inside expressions, that are made once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are made once for each row, however many expressions and filters read them (a generator of one row)."""
    made = rows.withColumn("made_", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*[c for c in rows.columns if c not in columns], *[F.col(f"made_.{n}").alias(n) for n in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
