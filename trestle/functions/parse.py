"""Numbers, units, dates and file facts as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.functions import lexicon as L
from trestle.functions.text import _col, collapse, normalize_table

NUMBER = r"^[+-]?\d+(\.\d+)?$"


def mapping(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def parse_number(c: Column | str) -> Column:
    """A strict decimal, spaces inside allowed, the first comma as the point; else null."""
    t = F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\s", ""), r"^([^,]*),", "$1.")
    return F.when(F.regexp_like(t, F.lit(NUMBER)), t.cast("double"))


def parse_loose_number(c: Column | str) -> Column:
    """A decimal or exponent number, spaces inside allowed; empty text is zero; else null."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s", ""), r"^([^,]*),", "$1.")
    return F.when(t == "", F.lit(0.0)).when(F.regexp_like(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), t.cast("double"))


def finite(c: Column | str) -> Column:
    n = _col(c).cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def ceil_to_step(value: Column, step: Column | float = 1.0) -> Column:
    """The next multiple of a step; a step that is null or zero counts as 1."""
    s = step if isinstance(step, Column) else F.lit(float(step))
    s = F.coalesce(F.when(s != 0, s), F.lit(1.0))
    return F.ceil(value / s).cast("double") * s


def table_unit(c: Column | str) -> Column:
    """Canonical unit of a table cell, '' if unknown."""
    return F.coalesce(mapping(L.TABLE_UNITS)[F.regexp_replace(normalize_table(c), " ", "")], F.lit(""))


def quantity_unit(c: Column | str) -> Column:
    """Unit of a quantity in running text: the first rule that matches anywhere, else the text itself."""
    t = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    out = t
    for pattern, unit in reversed(L.QUANTITY_UNITS):
        out = F.when(F.regexp_like(t, F.lit(pattern)), F.lit(unit)).otherwise(out)
    return out


def material_unit(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)\s+", ""), r"\.$", "")
    return F.coalesce(mapping(L.MATERIAL_UNITS)[t], t)


def parse_date_text(c: Column | str) -> Column:
    """ISO text of a date cell: a spreadsheet day number, a leading yyyy-m-d or a leading d.m.yy(yy); the day is not checked."""
    t = F.trim(F.coalesce(_col(c), F.lit("")))
    serial = F.when(F.regexp_like(t, F.lit(r"^\d+(\.\d+)?$")), t.cast("double"))
    day = F.when((serial > 20000) & (serial < 80000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial + 0.5).cast("int")), "yyyy-MM-dd"))
    part = lambda p, i: F.regexp_extract(t, p, i)
    iso, ru = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})"
    two = lambda x: F.lpad(x, 2, "0")
    year = F.when(F.length(part(ru, 3)) == 2, F.concat(F.lit("20"), part(ru, 3))).otherwise(part(ru, 3))
    return F.coalesce(
        day,
        F.when(part(iso, 1) != "", F.concat_ws("-", part(iso, 1), two(part(iso, 2)), two(part(iso, 3)))),
        F.when(part(ru, 1) != "", F.concat_ws("-", year, two(part(ru, 2)), two(part(ru, 1)))),
    )


def parse_date(c: Column | str) -> Column:
    return F.try_to_date(parse_date_text(c), "yyyy-MM-dd")


def duration_days(start: Column, finish: Column) -> Column:
    """Days from start to finish, both counted; null if one is missing or they are in the wrong order."""
    return F.when(finish >= start, F.datediff(finish, start) + 1)


def source_priority(kind: Column | str) -> Column:
    return F.coalesce(mapping(L.SOURCE_PRIORITY)[_col(kind)], F.lit(10))


def extension(name: Column | str) -> Column:
    """Lower-case text after the last dot, '' without a dot."""
    return F.when(F.contains(_col(name), F.lit(".")), F.lower(F.element_at(F.split(_col(name), r"\."), -1))).otherwise(F.lit(""))


def file_id(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("-", name, size.cast("string"), modified.cast("string"))


def content_hash(content: Column, name: Column, size: Column, modified: Column) -> Column:
    """SHA-256 of the content, or a fingerprint of name, size and time where there is none."""
    return F.coalesce(F.sha2(content.cast("binary"), 256), F.concat_ws("|", F.lit("meta"), name, size.cast("string"), modified.cast("string")))


def size_label(size: Column) -> Column:
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    kb, mb = size / 1024.0, size / 1048576.0
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" Б"))).when(kb < 1024, F.concat(tenth(kb), F.lit(" КБ"))).otherwise(F.concat(tenth(mb), F.lit(" МБ")))


def text_layer(with_text: Column, total: Column) -> Column:
    return F.when(with_text == 0, "scan").when(with_text == total, "text").otherwise("mixed")
