"""The engine's inputs made from the driver's star schema: materials, contexts, changes, revisions and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.sources.tables import read_table

AS_OF = "1999-06-01"
SAFETY_DAYS = 2


def materials(spark: SparkSession, sf: str) -> DataFrame:
    """A material for each part and tenth of the suppliers that is still needed; need_date comes from its earliest open order."""
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 10).alias("slot"), "l_quantity", "l_linestatus", "l_returnflag", F.to_date("l_shipdate").alias("shipped"))
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ordered"))
    open_, sent = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    total = lambda test: F.sum(F.when(test, F.col("l_quantity")).otherwise(0.0))
    firm = open_ & (F.col("l_returnflag") == "N")
    sums = lines.join(orders, "l_orderkey").groupBy("l_partkey", "slot").agg(
        total(open_).alias("need"), total(sent).alias("stock"), total(sent & (F.col("l_returnflag") == "R")).alias("reserved"), total(firm).alias("confirmed"),
        F.max(F.when(firm, F.col("shipped"))).alias("delivery"), F.min(F.when(open_, F.col("ordered"))).alias("start"),
    )
    k = F.col("l_partkey")
    return sums.where("need > 0").select(
        k.alias("part_key"), "slot", "need", "stock", "reserved", "confirmed", "delivery", F.date_sub("start", SAFETY_DAYS).alias("need_date"), (k % 30 + 1).cast("int").alias("lead_days"),
        F.concat(F.lit("P"), k % 7).alias("project"), F.concat(F.lit("O"), "slot").alias("object"), F.concat(F.lit("W"), k % 11).alias("work"),
        F.when(k % 13 != 0, F.concat(F.lit("S"), "slot")).alias("responsible"), F.concat(F.lit("part "), k).alias("name"), (k * 10 + F.col("slot")).alias("ord"),
    )


MATERIALS_SQL = f"""
lines AS (
    SELECT l_partkey AS k, l_suppkey % 10 AS slot, l_quantity AS q, l_linestatus AS ls, l_returnflag AS rf, CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), sums AS (
    SELECT k, slot, sum(CASE WHEN ls = 'O' THEN q ELSE 0 END) AS need, sum(CASE WHEN ls = 'F' THEN q ELSE 0 END) AS stock, sum(CASE WHEN ls = 'F' AND rf = 'R' THEN q ELSE 0 END) AS reserved,
        sum(CASE WHEN ls = 'O' AND rf = 'N' THEN q ELSE 0 END) AS confirmed, max(CASE WHEN ls = 'O' AND rf = 'N' THEN shipped END) AS delivery, min(CASE WHEN ls = 'O' THEN ordered END) AS start
    FROM lines GROUP BY k, slot
), materials AS (
    SELECT k AS part_key, slot, need, stock, reserved, confirmed, delivery, CAST(start - INTERVAL {SAFETY_DAYS} DAY AS DATE) AS need_date, CAST(k % 30 + 1 AS INTEGER) AS lead_days,
        'P' || (k % 7) AS project, 'O' || slot AS object, 'W' || (k % 11) AS work, CASE WHEN k % 13 <> 0 THEN 'S' || slot END AS responsible, 'part ' || k AS name, k * 10 + slot AS ord
    FROM sums WHERE need > 0
), state AS (
    SELECT *, greatest(stock - reserved, 0) AS free, greatest(stock - reserved, 0) + confirmed AS available, greatest(need - (greatest(stock - reserved, 0) + confirmed), 0) AS deficit,
        CAST(need_date - lead_days * INTERVAL 1 DAY AS DATE) AS order_deadline
    FROM materials
), flags AS (
    SELECT *, (need_date IS NULL OR deficit > 0 OR coalesce(delivery > need_date, false)) AS critical, deficit > 0 AS "order", free < need AS low_stock,
        coalesce(confirmed > 0 AND delivery >= DATE '{AS_OF}', false) AS expected, coalesce(confirmed > 0 AND delivery < DATE '{AS_OF}' AND free < need, false) AS delayed, free >= need AS ok
    FROM state
), events_ AS (
    SELECT *, CASE WHEN delayed THEN 'delayed' WHEN critical THEN 'critical' WHEN "order" THEN 'order' WHEN low_stock THEN 'low-stock' WHEN expected THEN 'expected' ELSE 'ok' END AS "primary"
    FROM flags
)"""


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Work contexts with repeats and odd spelling: one for each customer, labels as materials have them, in other letter case and with spaces."""
    k = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit(" p"), k % 7).alias("project"), F.concat(F.lit("o"), k % 10, F.lit(" ")).alias("object"), F.concat(F.lit("w"), k % 11).alias("work"),
        F.date_add(F.lit("1998-01-01").cast("date"), (k % 200).cast("int")).alias("start"), (k % 5).cast("int").alias("safety_days"), k.alias("ord"),
    )


CONTEXTS_SQL = """
contexts AS (
    SELECT 'p' || (c_custkey % 7) AS kp, 'o' || (c_custkey % 10) AS ko, 'w' || (c_custkey % 11) AS kw, DATE '1998-01-01' + CAST(c_custkey % 200 AS INTEGER) AS start, CAST(c_custkey % 5 AS INTEGER) AS safety_days, c_custkey AS ord
    FROM customer
)"""

ACTIONS = {"signup": "create", "view": "update", "click": "update", "error": "archive", "purchase": "restore"}


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Register changes from events: key, seq, ts, action, need and unit."""
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")]
    return read_table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", action.alias("action"), F.round("value", 2).alias("need"), F.when(F.col("event_id") % 3 == 0, "шт").otherwise("м").alias("unit"))


CHANGES_SQL = """
changes AS (
    SELECT user_id AS key, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update' WHEN 'error' THEN 'archive' WHEN 'purchase' THEN 'restore' END AS action,
        round(value, 2) AS need, CASE WHEN event_id % 3 = 0 THEN 'шт' ELSE 'м' END AS unit
    FROM events
)"""


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Document revisions from orders: a customer is a document, an order a revision of it; finished orders are approved."""
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("revision"), F.to_date("o_orderdate").alias("received"), (F.col("o_orderstatus") == "F").alias("approved"))


REVISIONS_SQL = """
revisions AS (
    SELECT o_custkey AS document, o_orderkey AS revision, CAST(o_orderdate AS DATE) AS received, o_orderstatus = 'F' AS approved FROM orders
), promoted AS (
    SELECT *, CASE WHEN approved AND row_number() OVER (PARTITION BY document, approved ORDER BY received DESC, revision DESC) = 1 THEN 'current' WHEN approved THEN 'superseded' ELSE 'received' END AS status FROM revisions
)"""


def schedule_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A schedule workbook for each order priority: a header row, then a row for each order with its dates, some of them missing."""
    orders = read_table(spark, sf, "orders")
    spans = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("last"), F.sum("l_quantity").alias("total"))
    rows = orders.join(spans, "o_orderkey").select(
        F.col("o_orderpriority").alias("doc"), F.lit("лист 1").alias("sheet"), F.col("o_orderkey").cast("int").alias("row_idx"),
        F.concat(F.when(F.col("o_orderkey") % 7 == 0, "Монтаж секции ").when(F.col("o_orderkey") % 7 == 1, "Песок ").when(F.col("o_orderkey") % 7 == 2, "Итого по ").when(F.col("o_orderkey") % 7 == 3, "Кран ").otherwise("Позиция "), "o_orderkey").alias("name"),
        F.when(F.col("o_orderkey") % 11 != 0, "шт.").otherwise("набор").alias("unit"), F.col("total").cast("int").cast("string").alias("total"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "dd.MM.yyyy")).alias("start"), F.when(F.col("o_orderkey") % 13 != 0, F.date_format("last", "yyyy-MM-dd")).alias("finish"),
    )
    names = ["name", "unit", "total", "start", "finish"]
    body = rows.select("doc", "sheet", "row_idx", F.posexplode(F.array(*names)).alias("col_idx", "value"))
    titles = F.array(*map(F.lit, ["Наименование работ", "Ед. изм.", "Количество", "Начало работ", "Окончание работ"]))
    head = rows.select("doc", "sheet").distinct().select("doc", "sheet", F.lit(0).alias("row_idx"), F.posexplode(titles).alias("col_idx", "value"))
    return head.unionByName(body.withColumn("row_idx", F.col("row_idx") + 1)).where("value is not null")


#: Workbooks by the nation's number modulo 5: file name, and the cells of its first rows.
BOOKS = (
    ("ГПР", (("Наименование работ", "Ед. изм.", "Количество", "Начало работ", "Окончание работ"),)),
    ("Книга", (("Ведомость объемов работ",), ("Наименование работ", "Ед. изм.", "Количество"))),
    ("Книга", (("Спецификация материалов",), ("Наименование", "Ед. изм.", "Количество"))),
    ("Смета", (("Материалы и работы", "Стоимость"), ("Наименование", "Ед. изм.", "Количество", "Стоимость"))),
    ("Лист", (("Наименование", "Ед. изм.", "Количество"),)),
)


def order_books(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a workbook for each nation: first rows by BOOKS, then a row for each order of its customers."""
    names = F.element_at(F.array(*[F.lit(n) for n, _ in BOOKS]), (F.col("n_nationkey") % len(BOOKS) + 1).cast("int"))
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(names, F.lit(" "), "n_nationkey", F.lit(".xlsx")).alias("doc"))
    rows = [(i, r, c, v) for i, (_, head) in enumerate(BOOKS) for r, cells in enumerate(head) for c, v in enumerate(cells)]
    heads = spark.createDataFrame(rows, "book int, row_idx int, col_idx int, value string")
    top = nation.join(heads, F.col("nation") % len(BOOKS) == F.col("book")).select("doc", F.lit("лист 1").alias("sheet"), "row_idx", "col_idx", "value")
    orders = read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("nation"))
    cells = F.array(F.concat(F.lit("Позиция "), "o_orderkey"), F.lit("шт"), F.col("o_custkey").cast("string"))
    body = orders.select("doc", F.lit("лист 1").alias("sheet"), (F.col("o_orderkey") + 10).cast("int").alias("row_idx"), F.posexplode(cells).alias("col_idx", "value"))
    return top.unionByName(body)


#: The page of an order by its number modulo 4: kind, first words.
PAGE_KINDS = (("work-volume", "Ведомость объемов работ. "), ("specification", "Спецификация оборудования, изделий и материалов\n"), ("explanatory-note", "Пояснительная записка. "), ("schedule", "Календарный график производства работ. "))
VARIANTS = ("Подземная", "На эстакаде", "Надземная")
MATERIALS = (("Кабель ВВГнг 3х2,5", "м"), ("Труба ПНД 110", "кг"), ("Шкаф управления ШУ-10", "шт"), ("Монтаж опоры", "шт"), ("Муфта соединительная", "компл."))
SENTENCES = (
    "До начала работ необходимо согласовать с РЖД производство работ.", "Уведомить заказчика о начале работ за 5 дней!", "Замена кабеля возможна по согласованию с балансодержателем сетей.",
    "Получить разрешение до производства работ в охранной зоне.", "Изм. Кол.уч Лист №док Подп. Дата согласовано;", "Проектная организация согласовывает изменения.",
)


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each order: doc (its customer), page (the order), kind, nation (the customer's) and text, a piece for each line."""
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    k, n, kind = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey") % 4
    whole = F.col("l_quantity").cast("int").cast("string")
    amount = F.when(k % 5 == 0, F.concat(F.lit("1 "), F.lpad(whole, 3, "0"), F.lit(",5"))).otherwise(whole)
    piece = (
        F.when(kind == 0, F.concat(of(VARIANTS, k), F.lit(" кабельная канализация, протяженность "), amount, F.lit(" м; муфта "), n, F.lit(" шт. ")))
        .when(kind == 1, F.concat(n, F.lit(" "), of([m for m, _ in MATERIALS], k), F.lit(" "), of([u for _, u in MATERIALS], k), F.lit(" "), whole, F.lit("\n")))
        .when(kind == 2, F.concat(of(SENTENCES, k), F.lit(" ")))
        .otherwise(F.concat(F.lit("Начало работ "), F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit(". ")))
    )
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", piece.alias("t")))).alias("lines"))  # an order has few lines
    head = F.element_at(F.array(*[F.lit(h) for _, h in PAGE_KINDS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(head, F.array_join(F.transform("lines", lambda x: x["t"]), ""))
    orders = read_table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), of([x for x, _ in PAGE_KINDS], F.col("o_orderkey")).alias("kind"), F.col("c_nationkey").alias("nation"), text.alias("text"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PAGES_SQL = f"""
lines_ AS (
    SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) AS q, l_shipdate AS d FROM lineitem
), pieces_ AS (
    SELECT k, n, p, CASE k % 4 WHEN 0 THEN {_listed(VARIANTS)}[p % {len(VARIANTS)} + 1] || ' кабельная канализация, протяженность ' || CASE WHEN p % 5 = 0 THEN '1 ' || lpad(q, 3, '0') || ',5' ELSE q END || ' м; муфта ' || n || ' шт. '
        WHEN 1 THEN n || ' ' || {_listed([m for m, _ in MATERIALS])}[p % {len(MATERIALS)} + 1] || ' ' || {_listed([u for _, u in MATERIALS])}[p % {len(MATERIALS)} + 1] || ' ' || q || chr(10)
        WHEN 2 THEN {_listed(SENTENCES)}[p % {len(SENTENCES)} + 1] || ' ' ELSE 'Начало работ ' || strftime(d, '%d.%m.%Y') || '. ' END AS t FROM lines_
), pages_ AS (
    SELECT o_custkey AS doc, o_orderkey AS page, {_listed([x for x, _ in PAGE_KINDS])}[o_orderkey % 4 + 1] AS kind, c_nationkey AS nation, {_listed([h for _, h in PAGE_KINDS])}[o_orderkey % 4 + 1] || x.t AS text
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT k, string_agg(t, '' ORDER BY n, p, t) AS t FROM pieces_ GROUP BY k) x ON x.k = o_orderkey
)"""
