"""Corpus pipeline over ``documents``: clean, remove exact and near copies, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it back as the next one's input. All
stages but the last return the columns of ``documents``.

* ``quality_rules``: documents that fail the base rules or lose too much text go; the
  failing lines of the others are taken out and ``n_chars`` is counted anew.
* ``exact_dedup``: of equal texts the row with the largest id stays.
* ``near_dedup``: of each near-duplicate class the row with the smallest id stays.
* ``mixing``: rows are left out or repeated to meet the target weights.
* ``encoding``: ids and decoded text of every row.

Null texts are empty and go with the first stage; empty tables pass through every
stage; columns beyond those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.llm import bpe, exact_dedup, minhash, quality_rules
from lagline.llm.common import stored, table
from lagline.llm.queries import WORD_VOCABULARY, mixed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    cleaned = quality_rules.clean(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.survivors(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class."""
    return minhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the target mixture; repeated rows are later epochs of a small source."""
    return mixed(docs).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their number and the text they decode to."""
    return bpe.round_trip(docs, WORD_VOCABULARY)


STAGES = [
    ("quality_rules", clean_lines),
    ("exact_dedup", drop_equal),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# Consistent weighted sampling has no SQL form; tests hold single stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
