"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's ``docs``. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, packing, quality_rules, secret_scan
from tidemark.llm import queries as named
from tidemark.llm import text as tx


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    tx.prepare(spark)
    return quality_rules.kept_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    tx.prepare(spark)
    return jaccard.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.clean(docs, named.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked."""
    tx.prepare(spark)
    return secret_scan.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    tx.prepare(spark)
    return packing.pack_documents(docs, named.tokenizer_file("byte_bpe_50k.json"), "byte", end_id=0)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

# Tiling and tokenisation have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = named.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tx.durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
