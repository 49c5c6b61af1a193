"""A training corpus from `documents`: quality rules, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents. The mixing stage
may repeat a document, or return the part of it that the mix takes.

Rows: a null or empty text fails the quality rules and goes in the first stage; so do texts under 50
words. Rows that repeat a doc_id are one document for near duplicates, of which one row stays; rows
without doc_id pass that stage. In a group of near duplicates the smallest doc_id stays. A document
exactly at a limit (posterior 0.5; a share of hit words of 1 in 20) is kept by the first and dropped by
the third stage. Very long texts are one row in every stage. Columns beyond doc_id, text and source go
along; slot and shard are replaced by the last stage's own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm.common import materialize, read_table
from quirelake.llm.decontamination import drop_contaminated
from quirelake.llm.mixing import apply_mix
from quirelake.llm.near_dedup import drop_near_duplicates
from quirelake.llm.quality_rules import keep_good
from quirelake.llm.sharding import shard_documents

#: Expectation-maximisation, components and seeded block selection have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights, by words."""
    return apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
