"""Corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, sequences are packed.

Stages take the columns of documents, and any others, as they come. Defined results, by stage: null and empty texts are
not toxic, are copies of each other, have fingerprint zero, are mixed with size 0 (never repeated beyond whole
epochs) and pack as the end id alone; null ids and sources are kept as they are; fully repeated rows are copies, so one
stays; an empty table gives an empty result of every stage. What a stage writes on its way is deleted when its result
is written, and the result when the next stage's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, packing, simhash, toxicity
from quire.runtime import discard, scratch, shared_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model is fitted on the labels of ``sf_dir``."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_default(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(last)
        last = path
    return docs


#: SQL can express neither the toxicity model nor XXH64 fingerprints nor byte-pair encoding.
ORACLE_SQL = None
