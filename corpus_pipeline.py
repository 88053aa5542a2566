"""The corpus pipeline: quality rules, exact dedup, SimHash near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs, so no stage recomputes another. All but the last return the columns
of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from keyweave.llm.queries import MODEL_FILE
from keyweave.operators.durable import remove_folder, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject: those that fail the base rules or are more probably bad than good."""
    return quality_rules.keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id, as in op5."""
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over 5-word shingles, met by their SimHash popcounts: that with the smallest doc_id."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of op8; a document that the mix repeats has as many rows."""
    return mixing.mix(docs, weights=(3, 1, 2), budget_share=1.5, max_epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row."""
    encoded = sentencepiece_codec.encode(docs, MODEL_FILE)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Near copies, the EM fit, the mix and the encoding have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; a stage's folder goes when the next one has read it."""
    folder = os.path.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
