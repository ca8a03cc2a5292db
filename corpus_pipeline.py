"""From raw documents to token ids: language, near duplicates, repeated passages, benchmark items, pieces.

Every stage takes all documents that the one before kept. All but the last return the columns of ``documents``; texts
that change get their new length as n_chars. Rows with a NULL id pass the stages that cannot tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpulse.llm import decontam, langid, ngram_join, paragraphs, pieces
from tickerpulse.llm.stored import free_name, release, stored

ROWS_PER_BATCH = "1000"  # texts are long: Arrow batches of the usual 10 000 of them take tens of MB on both sides
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
MIN_SHARE = 0.4  # of the words in one language
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a main language: less than ``MIN_SHARE`` of the words are in any one."""
    known = docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    model = langid.fit(known, "text", "lang")
    label = free_name(docs, "language")
    found = langid.label(docs, "text", model, out=label, spans=False)
    kept = (F.col(f"{label}.lang") != langid.UNDETERMINED) & (F.col(f"{label}.score") >= MIN_SHARE)
    return found.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id stays. Rows that repeat an id and a text
    are one document."""
    lost = ngram_join.similar(docs, "doc_id", "text").where("doc_id IS NOT NULL AND NOT kept")
    key = ["doc_id", free_name(docs, "text_hash")]
    rest = docs.withColumn(key[1], F.xxhash64("text")).join(lost.select("doc_id", F.col("text_hash").alias(key[1])).distinct(), key, "left_anti")
    if not rest.where("doc_id IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rest = rest.where("doc_id IS NULL").unionByName(rest.where("doc_id IS NOT NULL").dropDuplicates(key))
    return rest.select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; documents that have no word left go."""
    spans = paragraphs.removals(docs, "doc_id", "text")
    before = free_name(docs, "before")
    marked = paragraphs.without(docs.withColumn(before, F.length("text")), spans, "doc_id", "text")
    emptied = (F.length("text") < F.col(before)) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    changed = F.when(F.length("text") < F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed).select(*docs.columns)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one with its answer."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(decontam.contaminated(docs, benchmark, "doc_id", "text", "item_id", "text"), "contaminated")
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def in_small_batches(stage: Stage) -> Stage:
    """The stage, run and written with few rows per Arrow batch."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with proof that they give the text back."""
    return pieces.digest(docs, "doc_id", "text", PIECE_MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("language", in_small_batches(identify_language)),
    ("near_duplicates", in_small_batches(drop_near_duplicates)),
    ("repeated_passages", in_small_batches(cut_repeated_passages)),
    ("benchmark", in_small_batches(drop_benchmark_items)),
    ("pieces", in_small_batches(encode_pieces)),
]
# Trained scores, banding, latent retrieval and Viterbi segmentation have no SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again; what the next has read whole goes."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(*read)
        read = [docs]
    return docs
