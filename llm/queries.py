"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from llm import alignment, bpe, conversations, forest, jaccard, licenses, linededup, mixing, perplexity, quality, sharding, sqltext, toxicity, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_jaccard_components")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 4-word shingle sets at a Jaccard similarity of 0.85."""
    return jaccard.components_of(documents(spark, sf_dir), words=4, num=85, den=100)


SQL["op1_jaccard_components"] = sqltext.components_sql(4)


@query("op8_hypergeometric_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into eight shards of exact sizes."""
    return sharding.shard_query(documents(spark, sf_dir))


@query("op9_systematic_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets by systematic sampling."""
    return mixing.mix_query(documents(spark, sf_dir))


SQL["op9_systematic_mix"] = mixing.SQL


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the public word tokenizer."""
    return bpe.round_trip(documents(spark, sf_dir), bpe.tokenizer_path(spark))


@query("op10_winnowing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents, their edited texts and their neighbours."""
    return winnow.edited(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op5_ftrl_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    return toxicity.toxic_query(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op3_bradley_terry_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from preference pairs of the labels that are not held out."""
    return quality.quality_query(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op7_chunk_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that occur before."""
    return linededup.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


@query("op2_kneser_ney_perplexity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands for all documents, under a model of all documents."""
    return perplexity.rules(documents(spark, sf_dir))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents as files, their own or the nearest directory's."""
    return licenses.license_query(documents(spark, sf_dir))


@query("op11_interval_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte alignment of two public tokenizers over all documents."""
    return alignment.align_query(documents(spark, sf_dir), spark)


@query("op12_lsh_forest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by 3-word shingle sets at a Jaccard similarity of 0.85, found by an LSH forest."""
    return forest.near_copies(documents(spark, sf_dir), words=3, num=85, den=100)


SQL["op12_lsh_forest"] = sqltext.components_sql(3, kept=True)


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    return conversations.repair_query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL["op13_conversation_repair"] = conversations.SQL


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
