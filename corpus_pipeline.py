"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfell.llm import jaccard, langid, packing, quality, substring
from netfell.scratch import Scratch
from netfell.tables import reachable, table

#: Words of a shingle and similarity in percent for near duplicates.
WIDTH, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is surely in one of the languages that the labelled documents are in."""
    reachable(spark)
    return langid.keep(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    reachable(spark)
    return jaccard.one_of_each(docs, WIDTH, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages; n_chars follows the text."""
    reachable(spark)
    cleaned = substring.remove_from(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(cleaned.schema["n_chars"].dataType)) if "n_chars" in cleaned.columns else cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    reachable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("pattern_packing", packed)]

#: SQL cannot express the language model, the sketches' classifier or the packing; tests/llm holds run() against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
