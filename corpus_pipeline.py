"""A corpus pipeline of five stages, each by one operator of ``llm``.

Toxic documents go; of repeated chunks of lines the first occurrence stays; of each group of near copies one document
stays; sources are mixed to their target weights; the mix is encoded and decoded. Each stage's result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, jaccard, linededup, mixing, toxicity
from llm.store import written


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and own, a struct of all columns but text: what operators add cannot clash with what docs has."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """rows with the columns of docs again; text is the rows' own."""
    new = {"text": F.col("text")} | changed
    return rows.select(*[(new[c] if c in new else F.col("own")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model, learned from the labels that are not held out, scores 1/2 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = labels.where(toxicity.remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return unpacked(toxicity.scored(packed(docs), toxicity.fit(docs, rows)).where("score < 0.5"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the repeated chunks of lines cut from their texts; all rows stay, n_chars follows the text."""
    return unpacked(linededup.without_repeats(packed(docs)), docs, n_chars=F.length("text").cast("long"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each component of 5-word shingle sets at a Jaccard similarity of 0.8."""
    return jaccard.one_of_each(docs, words=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes each."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of docs, encoded and decoded."""
    return bpe.round_trip(docs, bpe.tokenizer_path(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", one_of_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]
#: Learned weights and tokenizer merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
