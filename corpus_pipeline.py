"""Cleaning of the documents table in stages: language, near copies, benchmark passages, secrets, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

* language: documents without a letter, or whose language is uncertain, go;
* near copies (five-word shingles, similarity 0.8): of each group the document with the smallest id stays (of rows that repeat
  an id and its text, one); a document without words is no copy and stays;
* benchmark: documents that hold a benchmark passage go;
* secrets: every span found is replaced by ``[kind]``, and ``n_chars`` follows the new text;
* packing: the pieces of the packed windows.

SQL can't express the language model and the sketches, so there is no SQL for the whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import blob_ledger, fast_sketch_dedup, window_packing, winnowing, word_backoff_language
from voxelith.llm.queries import tokenizer_path
from voxelith.llm.text import id_crc, read_table
from voxelith.session import cut_lineage, ensure_checkpoint_dir

LEAST_SCORE = 0.5  # share of the best language in a document's evidence


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = word_backoff_language.fit(docs, F.pmod(id_crc(), F.lit(4)) != 2)
    judged = word_backoff_language.predict(docs, model, "text", "_language", "_language_score")
    sure = (F.col("_language") != word_backoff_language.UNKNOWN) & (F.col("_language_score") >= LEAST_SCORE)
    return judged.where(sure).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = fast_sketch_dedup.near_copies(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_kept"))
    # rows that share an id (or have none) but not their text are different documents
    return docs.join(kept, same, "left_semi").withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"]).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_mark"))
    return docs.join(found, same, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = ["doc_id"]
    addressed = blob_ledger.address(docs, keys)
    ledger = cut_lineage(blob_ledger.scan_unseen(addressed, keys, blob_ledger.RULES))
    found = blob_ledger.blob_spans(ledger, blob_ledger.RULES).select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    joined = docs.withColumn("_own", blob).join(found, F.col("_own") == F.col("_blob"), "left")
    hit = F.size(F.coalesce("_found", F.array())) > 0
    text = F.when(hit, blob_ledger.redacted(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return window_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between is kept under the checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
