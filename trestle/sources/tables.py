"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trestle.functions.parse import content_hash, extension, file_id

ACCEPTED = ("pdf", "xlsx", "xls", "csv")
MATERIAL = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("revision", T.IntegerType()), T.StructField("project", T.StringType()), T.StructField("object", T.StringType()),
    T.StructField("work", T.StringType()), T.StructField("name", T.StringType()), T.StructField("responsible", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("need", T.DoubleType()),
    T.StructField("stock", T.DoubleType()), T.StructField("reserved", T.DoubleType()), T.StructField("confirmed", T.DoubleType()), T.StructField("delivery", T.DateType()), T.StructField("lead_days", T.IntegerType()),
    T.StructField("source_document", T.StringType()), T.StructField("source_page", T.IntegerType()),
])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """Materials from JSON, an array or one object a line; missing status is active and missing revision 1. Broken records come with what they hold in ``_corrupt``."""
    schema = T.StructType([*MATERIAL.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("status", F.coalesce("status", F.lit("active"))).withColumn("revision", F.coalesce("revision", F.lit(1)))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as documents: doc_id, name, extension, bytes, modified, sha256 and content; other file types are rejected and each id comes once."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    out = out.withColumn("extension", extension("name")).where(F.col("extension").isin(*ACCEPTED))
    out = out.withColumn("doc_id", file_id(F.col("name"), F.col("bytes"), F.unix_millis("modified"))).withColumn("sha256", content_hash(F.col("content"), F.col("name"), F.col("bytes"), F.unix_millis("modified")))
    return out.dropDuplicates(["doc_id"])


def read_cells(spark: SparkSession, path: str, separator: str = ",", columns: int = 256) -> DataFrame:
    """Filled cells of CSV files, long: doc, sheet ('csv'), row_idx, col_idx, value. Rows without any value are left out before rows are numbered.

    Quoted cells may hold separators, line ends and doubled quotes, so a file is read as a whole by one task; files are
    spread over tasks. columns: the widest row that is expected; a wider one is an error, no cell is left out.
    """
    names = [f"c{i}" for i in range(columns)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in names)).option("sep", separator).option("maxColumns", columns).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = reader.csv(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.monotonically_increasing_id().alias("n"), F.array(*[F.nullif(F.trim(c), F.lit("")) for c in names]).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: c.isNotNull()))
    numbered = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("doc").orderBy("n")) - 1)
    return numbered.select("doc", "row_idx", F.posexplode("cells").alias("col_idx", "value")).where("value is not null").select("doc", F.lit("csv").alias("sheet"), "row_idx", "col_idx", "value")


def page_text(items: DataFrame, max_chars: int | None = None, min_visible: int = 1) -> DataFrame:
    """Pages from text items (doc, page, pos, text, line_end), spaces collapsed: whole pages, or their first max_chars characters; pages of fewer visible characters than min_visible are left out."""
    part = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("line_end"), "\n").otherwise(" "))
    pages = items.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    clean = F.btrim(F.regexp_replace(F.regexp_replace("t", "[ \\t]+", " "), "\\n\\s*\\n+", "\n"), F.lit(" \n"))
    out = pages.withColumn("t", clean).where(F.length(F.regexp_replace("t", r"(?U)\s+", "")) >= min_visible)
    return out.select("doc", "page", (F.col("t") if max_chars is None else F.substring("t", 1, max_chars)).alias("text"), F.length("t").alias("text_length"), (F.length("t") > max_chars if max_chars is not None else F.lit(False)).alias("truncated"))
