"""A corpus pipeline of operators from loomwork.llm: quality, toxicity, near copies, mixture and encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, common, mixing, quality, simhash, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of quality rules keeps."""
    return quality.accepted(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, by a classifier trained on labelled ones among them."""
    train = common.crc_mod("doc_id", 3) != 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(train)
    return toxicity.without_toxic(docs, toxicity.fit(docs.where(train), labels), least=0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.without_copies(docs, least=0.8, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents left out, taken once or twice, and one of each source cut at its budget."""
    return mixing.mixture(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("toxicity", toxic_documents), ("simhash", near_copies), ("mixing", mixed), ("bpe", token_ids)]
#: SQL cannot express the classifier, the fingerprints and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is stored before the next reads it, and only the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.scratch(spark) as last:
        for name, stage in STAGES:
            with common.scratch(spark) as result:
                docs = result(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return last(docs, "pipeline")
