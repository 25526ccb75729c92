"""Sources, sinks and streams."""

import random
import time
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from trestle.operators import history
from trestle.plans import driver_tables as D
from trestle.sources import stores as ST
from trestle.sources import tables as S
from trestle.sources.xlsx import XlsxSource, cells_of, read_xlsx
from trestle.streaming import runs

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Дата</t></is></c></row><row r="2"></row>
<row r="3"><c r="A3"><v>12.5</v></c><c r="C3" s="1"><v>45000</v></c></row></sheetData></worksheet>"""


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Лист" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Имя</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    expected = [("Лист", 0, 0, "Имя"), ("Лист", 0, 2, "Дата"), ("Лист", 1, 0, "12.5"), ("Лист", 1, 2, "2023-03-15")]
    got = read_xlsx(spark, str(tmp_path)).where("sheet is not null").orderBy("row_idx", "col_idx").collect()
    assert [tuple(r)[1:] for r in got] == expected
    assert "BadZipFile" in read_xlsx(spark, str(tmp_path)).where("sheet is null").first()["value"]
    spark.dataSource.register(XlsxSource)
    assert spark.read.format("xlsx_cells").load(f"{tmp_path}/a.xlsx").count() == 4


def big_workbook(path, rows, sheets=("Первый", "Второй")):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{s}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>им</t></r><r><t>я {i}</t></r></si>" for i in range(50)) + "</sst>")
        for k in range(len(sheets)):
            body = "".join(f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{i % 50}</v></c><c r="B{i + 1}"><v>{i + k}</v></c></row>' for i in range(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_a_large_workbook_streams(tmp_path):
    """100,000 rows: every cell as it was written, in a fraction of the memory that the parsed sheet would take."""
    big_workbook(tmp_path / "big.xlsx", 100_000)
    tracemalloc.start()
    n = 0
    with open(tmp_path / "big.xlsx", "rb") as f:
        for doc, sheet, row, col, value in cells_of("big.xlsx", f, "Второй"):
            assert (doc, sheet, value) == ("big.xlsx", "Второй", f"имя {row % 50}" if col == 0 else str(row + 1))
            n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 8 << 20


def test_sheets_are_partitions_and_filters_reach_them(spark, tmp_path):
    big_workbook(tmp_path / "a.xlsx", 30)
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    spark.dataSource.register(XlsxSource)
    cells = spark.read.format("xlsx_cells").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 4 and cells.where("sheet is not null").count() == 120
    assert sorted(r["value"].split(":")[0] for r in cells.where("sheet is null").collect()) == ["BROKEN_WORKBOOK", "UNSUPPORTED_FORMAT"]
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        some = spark.read.format("xlsx_cells").option("filters", "true").load(f"{tmp_path}/*.xlsx").where("doc = 'a.xlsx' and sheet in ('Второй', 'нет') and col_idx = 1 and value > '2'")
        assert some.rdd.getNumPartitions() == 1
        assert sorted(int(r["value"]) for r in some.collect()) == sorted(i for i in range(1, 31) if str(i) > "2")
    finally:
        spark.conf.set(key, before)


def test_uploads_and_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('Имя,"Кол, шт"\n\nпесок,5\n', encoding="utf-8")
    (tmp_path / "in" / "y.txt").write_text("нет")
    up = S.read_uploads(spark, str(tmp_path / "in")).collect()
    assert [r["name"] for r in up] == ["x.csv"] and len(up[0]["sha256"]) == 64
    cells = S.read_cells(spark, str(tmp_path / "in" / "x.csv")).orderBy("row_idx", "col_idx").collect()
    assert [(r["row_idx"], r["col_idx"], r["value"]) for r in cells] == [(0, 0, "Имя"), (0, 1, "Кол, шт"), (1, 0, "песок"), (1, 1, "5")]
    (tmp_path / "in" / "z.csv").write_text('"a;b";"с ""кавычкой"""\n"две\nстроки";;3\n', encoding="utf-8")
    cells = S.read_cells(spark, str(tmp_path / "in" / "z.csv"), ";").orderBy("row_idx", "col_idx").collect()
    assert [(r["row_idx"], r["col_idx"], r["value"]) for r in cells] == [(0, 0, "a;b"), (0, 1, 'с "кавычкой"'), (1, 0, "две\nстроки"), (1, 2, "3")]


def test_a_wider_row_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b,c,d\n", encoding="utf-8")
    assert S.read_cells(spark, str(tmp_path / "w.csv"), columns=4).count() == 4
    with pytest.raises(Exception, match="(?i)columns"):
        S.read_cells(spark, str(tmp_path / "w.csv"), columns=3).collect()


def test_reviews(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"document": "d", "page": 1, "name": "x"}, {"document": "d", "page": 2, "name": "y", "review_status": "rejected"}]')
    assert [r["review_status"] for r in ST.read_reviews(spark, str(tmp_path / "r.json")).orderBy("page").collect()] == ["pending", "rejected"]


def test_material_json_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": "a", "need": 2.0}, {"id": "b", "status": "archived", "revision": 3}]')
    got = S.read_materials(spark, str(tmp_path / "m.json"))
    assert [(r["id"], r["status"], r["revision"]) for r in got.orderBy("id").collect()] == [("a", "active", 1), ("b", "archived", 3)]
    S.write_json(got.drop("_corrupt"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_page_text(spark):
    rows = [("d", 1, 0, "Первая  строка текста", True), ("d", 1, 1, "и ещё", False), ("d", 2, 0, "мало", True)]
    got = S.page_text(spark.createDataFrame(rows, "doc string, page int, pos int, text string, line_end boolean")).collect()
    assert [(r["page"], r["text"], r["truncated"]) for r in got] == [(1, "Первая строка текста\nи ещё", False), (2, "мало", False)]
    short = S.page_text(spark.createDataFrame(rows, "doc string, page int, pos int, text string, line_end boolean"), max_chars=6, min_visible=20).collect()
    assert [(r["page"], r["text"], r["truncated"]) for r in short] == [(1, "Первая", True)]


def test_stores(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "1", "start": "2026-01-02", "safety_days": "x"}, {"id": "2", "start": "2026-01-02", "end": "2026-02-01", "safety_days": "3"}]')
    got = ST.read_contexts(spark, str(tmp_path / "c.json")).orderBy("id").collect()
    assert [(r["safety_days"], str(r["end"])) for r in got] == [(0, "2026-01-02"), (3, "2026-02-01")]
    (tmp_path / "p.json").write_text('[{"id": "1"}, {"id": "2", "parent_id": "1", "status": "archived"}]')
    assert [(r["node_type"], r["status"]) for r in ST.read_projects(spark, str(tmp_path / "p.json")).orderBy("id").collect()] == [("root", "active"), ("linked", "archived")]
    (tmp_path / "r.json").write_text('[{"document": "d"}]')
    assert [(r["status"], r["project_ids"]) for r in ST.read_register(spark, str(tmp_path / "r.json")).collect()] == [("received", [])]
    (tmp_path / "h.json").write_text('[{"id": "1", "action": "create"}')
    rows = ST.read_history(spark, str(tmp_path / "h.json"))
    assert ST.broken(rows.cache()).count() == 1 and ST.sound(rows).count() == 0


def test_changes_of_stores(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(3, "update", 1), (1, "update", 1), (1, "update", 1), (2, "archive", 2)], "key int, action string, at int")
    assert {(r["action"], tuple(r["ids"]), r["n"]) for r in ST.change_events(rows, "key", "action", "at").collect()} == {("update", (1, 3), 2), ("archive", (2,), 1)}
    m = spark.createDataFrame([("a", None, None), ("b", "archived", 4)], "id string, status string, revision int")
    got = {r["id"]: (r["status"], r["revision"], r["archive_reason"]) for r in ST.archive_all(m, at).collect()}
    assert got == {"a": ("archived", 2, "reset"), "b": ("archived", 4, None)}
    saved = spark.createDataFrame([("a", None, None)], "id string, created_at timestamp, updated_at timestamp")
    assert ST.stamped(saved, at).where("created_at = updated_at").count() == 1


def test_debounce(spark):
    times = [(1, "2026-01-01 00:00:00.000"), (2, "2026-01-01 00:00:00.200"), (3, "2026-01-01 00:00:00.700")]
    frame = spark.createDataFrame(times, "id int, t string").select(F.to_timestamp("t").alias("ts"))
    assert sorted(r["n_events"] for r in runs.debounced_runs(frame).collect()) == [1, 2]


def drained(spark, rows, path, name):
    """The rows that a stream over JSON files gives, file by file."""
    run = rows.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return spark.table(name)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    runs.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def test_streaming_lifecycle_equals_batch_replay_of_shuffled_batches(spark, tmp_path, rocksdb):
    """Changes of the events table, out of order over several micro-batches and some of them twice, against the batch replay."""
    whole = D.changes(spark, "/root/testdata/sf0.001").where("key < 6")
    rows = [(str(r["key"]), r["seq"], r["ts"].isoformat(), r["action"]) for r in whole.collect()]
    random.Random(5).shuffle(rows)
    schema = "key string, seq bigint, ts timestamp, action string"
    text = spark.createDataFrame([*rows, *rows[:20]], "key string, seq bigint, ts string, action string")
    for i, part in enumerate(text.randomSplit([1.0, 1.0, 1.0], 1)):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.createDataFrame([("end", 0, "2030-01-01T00:00:00", "create")], "key string, seq bigint, ts string, action string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drained(spark, runs.lifecycle(stream, delay="400 days"), tmp_path, "lifecycle_out")
    last = got.groupBy("key").agg(F.max_by(F.struct("status", "revision", "rejected"), F.col("revision") + F.col("rejected")).alias("s")).select("key", "s.*")
    batch = history.replay(whole, "key", ["seq"]).withColumn("key", F.col("key").cast("string"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 3


def test_streaming_lifecycle_drops_what_comes_too_late(spark, tmp_path, rocksdb):
    files = [[("a", 1, "2026-01-01T00:00:00", "create")], [("b", 2, "2026-01-02T00:00:00", "create")], [("b", 5, "2026-01-02T00:10:00", "update")], [("a", 3, "2026-01-01T00:10:00", "archive")], [("end", 4, "2027-01-01T00:00:00", "create")]]
    for rows in files:
        spark.createDataFrame(rows, "key string, seq bigint, ts string, action string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema("key string, seq bigint, ts timestamp, action string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drained(spark, runs.lifecycle(stream, delay="1 hour"), tmp_path, "late_out")
    assert sorted((r["key"], r["status"], r["revision"], r["rejected"]) for r in got.collect()) [-2:] == [("a", "active", 1, 0), ("b", "active", 2, 0)]


def test_new_arrivals_pass_once(spark, tmp_path):
    rows = [("x", "2026-01-01T00:00:00"), ("y", "2026-01-01T00:01:00"), ("x", "2026-01-01T00:20:00"), ("z", "2026-01-01T00:30:00"), ("y", "2026-01-01T00:40:00")]
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], "id string, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drained(spark, runs.new_arrivals(stream, "id", "ts"), tmp_path, "arrivals_out")
    assert sorted(r["id"] for r in got.collect()) == ["x", "y", "z"]
