"""From raw documents to shards, in five stages.

Every stage takes documents with any further columns, also ones whose names clash with those used within, and texts of any length; an empty table gives an empty one. What a stage does
with null texts, null and repeated doc_ids, repeated rows and ties is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, language_id, mixture, near_dedup, sharding
from quillspark.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without a letter, and those whose likeliest language has a posterior probability under one
    half. The learned languages are those of the documents; of languages that are as likely, the first by name counts. Rows are judged one by one, so repeated ones stay together."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id (null last); a row is a document where doc_ids are null or repeated. Texts without words
    are copies of nothing and stay. Of rows that agree in all, one stays."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its whole text; null texts hold none. Rows with equal texts go or stay together. Without items, all stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice; those without words, or not taken, go. Rows that share a doc_id are each repeated as often as the one of
    them that is taken most; null sources form one source, and a null doc_id is one of its own. Ties of the hash order go by doc_id and size."""
    return mixture.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record's shard and slot. Repeated doc_ids go to one shard, with slots of their own; a null doc_id is the key ''; a null text has no bytes."""
    return sharding.assign(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("shard", shard)]
#: Language identification and signatures are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
