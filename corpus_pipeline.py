"""From raw documents to packed training sequences: each stage's Parquet is the next one's documents.

Every stage takes null, empty and very long texts, null ids and sources, repeated rows, an empty table and further columns
of any name; what it does with them is said at each. All but the last return the columns of the documents given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import mixing, packing, secret_scan, simhash, toxicity
from lexiloom.llm.common import durable
from lexiloom.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null text scores as an empty one; repeated rows go or stay alike; no document, or no label, is no error."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Texts without words are copies of each other; repeated rows leave one; rows of one id with different texts are
    documents of their own; a document without an id stays where no member of its group has one.
    """
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null and empty texts as they are. n_chars is counted anew where a text changed."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights in whole documents, each taken up to twice, in the schedule's order.

    A null source is one of its own; documents without words stay once, after the others.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset. A null text is an empty one and a piece of one id; repeated rows are packed one by one."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier, fingerprints, spans and packing are beyond SQL; tests/llm/test_pipeline.py holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of a folder; what a stage gives is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
