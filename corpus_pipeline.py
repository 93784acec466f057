"""The corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import bound_batches, materialize
from engram.llm.jaccard import keep_one
from engram.llm.packing import pack_documents
from engram.llm.quality import keep_good
from engram.llm.queries import VOCABULARY, digest_pieces
from engram.llm.substring import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the robust distance rejects go.

    Each row by its own text, null and repeated identifiers included; null and empty texts fail the base rules and go.
    Extra columns stay as they are, whatever their names; an empty table gives no row.
    """
    bound_batches(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier stays.

    Rows that repeat an identifier stay or go together; rows without an identifier or without words stay. Extra columns
    stay as they are; an empty table gives no row.
    """
    bound_batches(spark)
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go; a text that loses nothing stays as it is.

    All rows stay, with an empty text if all is lost; a null identifier neither removes nor loses words, rows that repeat
    one don't remove from each other. n_chars is counted anew, other columns stay, whatever their names.
    """
    bound_batches(spark)
    return without_repeats(docs, length=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences, of every row; a null or empty text is its end id alone."""
    bound_batches(spark)
    return digest_pieces(pack_documents(docs, public_tokenizers.path(VOCABULARY), length=1024, end_id=0))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The stages hold operators that SQL cannot express: iterated estimates, linked components, byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
