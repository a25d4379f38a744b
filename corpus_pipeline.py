"""A corpus pipeline of five stages over `documents`, each by one operator of routeloom.llm.

Every stage gets the documents that the stage before kept, and is written and read again
before the next. run() returns the packed pieces of the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import exact_dedup, language_id, near_copies, packing, sanitise
from routeloom.llm.common import new_folder, remove, stored, workspace
from routeloom.llm.queries import PIECES, WORD_TOKENIZER


def _kept(docs: DataFrame, decided: DataFrame, h: Column) -> DataFrame:
    """The rows of docs that stay by decided(doc_id, h, stays), which has a row for each row of docs; of rows that repeat id and h, one.

    Rows are told apart by their id and h, a hash of the text: an id that occurs with another text is another document.
    """
    decided = stored(decided.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "stays"), "decided")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), h.alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    rows = rows.join(decided.where("not stays").select("_id", "_h").distinct(), same, "left_anti")
    repeated = decided.where("stays").groupBy("_id", "_h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not repeated.isEmpty():
        once = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "h"])
        rows = rows.join(repeated, same, "left_anti").union(once)
    return rows.select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model is learned from the labelled languages of the documents themselves.

    Texts that are null, empty or without a letter go. Without any labelled document no language is recognised and all go.
    Each row is judged on its own: null ids and repeated rows are like others.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.train(docs.where(fold != 2), PIECES)
    return language_id.recognised(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts (see operator 4: white space, null texts). Of rows that repeat both, and of a group without ids, one stays."""
    decided = exact_dedup.duplicates(docs).select("doc_id", F.col("key").alias("h"), F.col("kept").alias("stays"))
    return _kept(docs, decided, exact_dedup.text_key(exact_dedup.normalised(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    Texts without a word, null ones too, are copies of each other only. Rows without an id go before others of their group.
    """
    decided = near_copies.near_copies(docs).select("doc_id", "h", "stays")
    return _kept(docs, decided, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced. n_chars is the length of the new text; a null text stays null, as does its length."""
    clean = sanitise.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Null and empty texts are one token; repeated rows and null ids are packed like others."""
    return packing.packed(docs, WORD_TOKENIZER)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("sanitise", private),
    ("best_fit_packing", packed),
]

#: The stages have models, fingerprints and tokenizers that SQL can't express; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with workspace(spark) as kept:  # what a stage has stored on its way goes when its result is written
            path = new_folder(spark, f"pipeline-{name}")
            kept.append(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
