"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mixing, sharding.

Each stage reads what its predecessor kept, whole, and returns the rows that stay, with the columns of documents; the last one
returns the shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemloom.llm import decontam, mixing, sharding, simhash, toxicity
from chemloom.llm.common import discard, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each pass that takes some of a document's words, cut where only blocks are taken."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot) of every row."""
    return sharding.shard(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", "tokens", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Hash fingerprints, trained votes and seeded draws have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the documents that all stages keep. Each stage is written and read again; its input's table goes once it is."""
    docs, place, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        if last:
            discard(spark, last)
        last = f"{place}/{name}"
        docs = spark.read.parquet(last)
    return docs
