"""A training-data pipeline: five stages over the documents table, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.llm import line_dedup, packing, quality, secrets, simhash
from sparkwave.llm.common import Scratch, table

#: Columns of documents; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose lines are mostly boilerplate go; null and empty texts fail. An empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return quality.retain(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; every document stays, also without a line left. Null texts stay null."""
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id; null and empty texts are one group."""
    return simhash.retain_one(docs.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays, null and empty texts as they are."""
    return _documents(secrets.redact_secrets(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; null and empty texts make a piece of one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The stages can't be expressed in SQL (a trained chain model, fingerprints, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with Scratch.inner():
            docs = scratch.save(stage(spark, before, sf_dir), name)
        scratch.drop(before)  # superseded; the input table isn't the scratch folder's and stays
    return STAGES[-1][1](spark, docs, sf_dir)
