"""A corpus pipeline: each stage takes the documents its predecessor kept, written as Parquet and read again.

1. quality: documents that the classifier rejects go.
2. near duplicates: one document of each component of the n-gram Jaccard join stays, the one with the smallest id.
3. secrets: every secret span in the texts is masked; all documents stay.
4. mixing: the documents are laid out in the order that keeps to the target weights of their sources.
5. tokens: each document encoded and decoded; its token count and the digests of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.ship import ship
from tessera.llm import bpe, mixing, ngram_join, quality, secrets
from tessera.llm.queries import vocabulary_path
from tessera.llm.spark_util import Stage, drop_since, small_batches, stages_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with a score of 0.5 and more; null and empty texts are scored like others, repeated rows stay repeated."""
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; texts without words are alone in theirs, rows without a doc_id stay."""
    ship(spark)
    return ngram_join.near_duplicate_keepers(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked and n_chars of changed texts counted anew; a null text stays null."""
    small_batches(ship(spark))
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture; a null source is a source."""
    return mixing.mixed_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and both digests of each row; a null text is an empty one."""
    small_batches(ship(spark))
    return bpe.encode_decode(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: No SQL can fit the classifier or run the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's result is written to the shared folder and read again."""
    stage = Stage(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        mark = stages_made()
        docs = stage.save(function(spark, docs, sf_dir), f"stage-{k}")
        drop_since(mark)  # what the stage's operator had staged
        if k:
            stage.drop(f"stage-{k - 1}")
    return docs
