"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.operators.durable import checkpointed, fresh, remove_folder, shared_folder

__all__ = ["WORD", "checkpointed", "fresh", "pieces", "read", "remove_folder", "shared_folder", "text_bytes", "text_or_empty", "word_count"]

#: A word is a run of characters other than the six ASCII white space characters; ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def pieces(total_bytes: int, piece_bytes: int, least: int = 1) -> int:
    """How many pieces of about piece_bytes each; grows with the input without an upper bound."""
    return max(least, -(-int(total_bytes or 0) // piece_bytes))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; one number reaches the driver."""
    return df.agg(F.sum(F.octet_length(text_or_empty(column)))).first()[0] or 0
