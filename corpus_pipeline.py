"""A training-data pipeline over `documents`: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results of all stages: an empty table gives an empty table; texts of any length are read whole; null lang, source or n_chars
are values like others; further columns of docs pass through (but for the last stage, which has columns of its own), those named like a column that an
operator adds come back with the operator's values. What nulls and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, langid, mixing, ngram_join, paragraphs
from folioflow.llm.common import cut, n_words, remove_path, shared_path, shrink_heaps
from folioflow.llm.queries import vocabulary_path

#: Rows of a list of ids up to which it is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null, empty or without letters, or with a posterior under one half. Rows with a null id are judged like others; repeated rows fare alike."""
    found = langid.identify(docs, docs.columns)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest id stays.

    Rows with a null id, which can't be named, stay; of rows that repeat a kept id and text, one stays.
    """
    groups = cut(ngram_join.cluster(docs, k=5, percent=80))
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_id")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    repeats = groups.where("doc_id = component_id").groupBy("doc_id", "set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeats.isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in a document with a smaller id; a document that loses every word goes. Null texts and rows with a null id stay as they are; rows that repeat an id lose alike."""
    shrink_heaps(spark)
    out = paragraphs.dedup(docs)
    out = out.where((F.col("removed_words") == 0) | (n_words(F.col("clean_text")) > 0))
    cleaned = F.col("spans").isNotNull()
    return out.withColumn("n_chars", F.when(cleaned, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("clean_text")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's rate; texts that are null or without words go, as no word of them is asked for. A null source is a source; equal rows are decided alike."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text again. A null text is empty; repeated rows are encoded alike."""
    shrink_heaps(spark)
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), vocabulary_path()).drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: SQL can't express the learned, iterative and tokenizing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. A stage's table goes when the next one is written; the last one's is read by the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
