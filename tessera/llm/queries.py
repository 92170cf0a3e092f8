"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ship import ship

from . import bpe, embedding, mixing, ngram_join, perplexity, pii, quality, secrets, shard, substring
from .spark_util import small_batches

Query = Callable[[SparkSession, str], DataFrame]

#: File name of the tokenizer vocabulary; its folder is that of the installed public_tokenizers.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(ship(spark)).read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_docs(spark, sf_dir))


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_docs(spark, sf_dir))
    return out.select("doc_id", "source", F.col("__bytes").alias("n_bytes"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__start").alias("start"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir), vocabulary_path())


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(_docs(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, sf_dir))


def op4_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_docs(spark, sf_dir))


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(_docs(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_dedup(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ship(spark), sf_dir)


def queries() -> dict[str, Query]:
    every = (
        op1_substring_dedup,
        op2_mix_to_weights,
        op3_bpe,
        op4_pii_boosted,
        op5_perplexity_rules,
        op6_quality_classifier,
        op7_two_pass_shuffle,
        op8_secret_scan,
        op9_ngram_jaccard_join,
        op10_embedding_graph,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracles() -> dict[str, str]:
    return {}
