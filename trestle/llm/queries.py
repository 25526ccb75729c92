"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm._common import bounded_batches, crc32_mod4, materialize, new_path
from trestle.llm.chat_format import format_windows, long_conversations, read_back
from trestle.llm.conversation_repair import damaged, repair, reports
from trestle.llm.decontaminate import find_contamination
from trestle.llm.exact_dedup import exact_dedup
from trestle.llm.fill_in_middle import fill_in_middle, restored
from trestle.llm.language_id import identify, prototypes
from trestle.llm.line_dedup import line_dedup
from trestle.llm.mixing import mix_sources, taken_words
from trestle.llm.quality import is_good, quality_scores
from trestle.llm.simhash import simhash_groups
from trestle.llm.substring_dedup import remove_repeats
from trestle.llm.token_files import read_token_files, write_token_files
from trestle.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(_table(spark, sf_dir, "documents"), share=1.5, max_repeats=2, block_words=64)
    return taken_words(mix).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = rows.unionByName(extra)
    read = read_back(format_windows(rows, stride=512, history=128))
    key = ["conv_id"] if long_conversations(rows).count() else ["conv_id", "block"]  # without long ones, the windows of each lie together already
    part = F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "loss_text")
    whole = read.groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, loss = (F.array_join(F.col(f"parts.{c}"), "") for c in ("said", "loss_text"))
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (crc32_mod4(F.col("doc_id")) == 2).alias("held_out"), "score", is_good(F.col("score")).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), out)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return read_warc(spark, out).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"), threshold=0.8)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2).select("doc_id", "fingerprint", "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(True))
    learned = materialize(prototypes(docs.where(~held_out("doc_id"))), "prototypes")
    return identify(docs, learned).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = reports(repair(damaged(rows))).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.select(
        "conv_id",
        *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, fim_percent=50, spm_percent=80)
    made = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("restored.sha256").alias("restored_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_chat_format, op3_token_files, op4_substring_dedup, op5_quality_classifier, op6_warc, op7_exact_dedup, op8_line_dedup, op9_simhash_dedup, op10_decontaminate, op11_language_id, op12_conversation_repair, op13_fill_in_middle)}
