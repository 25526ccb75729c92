"""A corpus from raw documents to token files, in five stages.

1. quality: the classifier's rejects go.
2. near-dedup: of each group of near copies, the document with the smallest id stays. SimHash signatures give candidates,
   which are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
3. decontamination: documents with a benchmark window go.
4. mixing: sources are brought to their target weights; a row for each time that a document's words are taken.
5. tokens: texts are written as token files and read back.

Each stage gets its predecessor's table from Parquet.

Defined cases: a null or empty text has zero statistics and is scored like any other, shares its near-copy group with all
wordless texts, holds no benchmark window, gives no words to the mix (so it ends there) and would be the end id alone in token
files; a null id is never dropped as a near copy; rows of one id and text are one after stage 2; a null source is a
source of its own, last in order; a very long text is read whole by one task in each stage; an empty table passes all stages;
extra columns are kept by stages 1 to 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm._common import bounded_batches, materialize, new_path
from trestle.llm.decontaminate import decontaminate
from trestle.llm.mixing import mix_sources, mixed_documents
from trestle.llm.quality import filter_quality
from trestle.llm.queries import tokenizer_path
from trestle.llm.simhash import simhash_dedup
from trestle.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash_dedup(docs, shingle_words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return mixed_documents(docs, mix_sources(docs, share=1.5, max_repeats=2, block_words=64))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = new_path(spark, "corpus")
    write_token_files(docs, out, tokenizer_path(), end_id=2)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Fingerprints, a trained classifier and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
