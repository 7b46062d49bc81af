"""The corpus pipeline: five stages over documents, each on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result as Parquet and reads it back.

Edge cases: empty tables give empty results; null texts go at the first stage, which rejects them; rows
with a null doc_id stay, as no stage can group them; repeated rows of one doc_id stay or go together, as they
are one document; very long texts are taken whole; extra columns, whatever their names, pass through the
first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardioframe.llm import bpe, decontam, jaccard, kit, langid, lines
from cardioframe.llm.queries import fold, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier tells; what it rejects goes."""
    return langid.keep_identified(docs, langid.train(docs, fold(4) != 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites hold; n_chars is that of the new text."""
    kept = lines.remove(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id."""
    found = jaccard.join(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    return docs.join(found, docs["doc_id"] == found["copy"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items of under five words remove nothing."""
    found = kit.stage(decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("passage").select("doc_id").distinct())
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded texts, and the number of tokens, of each document."""
    return bpe.encode(docs, tokenizer_path(), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("bpe", tokenize),
]

#: SQL can express neither compression, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kit.stage(stage(spark, docs, sf_dir))
    return docs
