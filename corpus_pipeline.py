"""The corpus pipeline: rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. ``run`` writes each stage's result to the shared folder as Parquet and reads it
back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm.jaccard_join import keep_one
from strandmill.llm.mixing import mix_documents
from strandmill.llm.packing import pack_documents
from strandmill.llm.quality_rules import keep_good
from strandmill.llm.secret_scan import redact_secrets
from strandmill.session import durable, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, every credential redacted that is not a widely copied example."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; sources weigh 5, 2, 1 in turn and share 150% of all words."""
    return mix_documents(docs, [5, 2, 1], 1.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates, mixing by a hash and packing have no plain SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
