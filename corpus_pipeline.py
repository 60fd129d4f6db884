"""A corpus from raw documents to token ids: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, for all rows that their operator keeps (mixing repeats rows).

In every stage a null text counts as empty, very long texts are handled whole, an empty table gives an
empty result, and extra columns, whatever their names, pass through (the last stage drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralume.llm import bpe, exact_dedup, mixing, near_dup, repetition
from terralume.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; texts without words are rejected, repeated rows judged alike."""
    return repetition.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: most code points, then smallest doc_id (null last), then any one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays: smallest doc_id (null last), then the text's smallest hash.

    Of rows that agree in doc_id and text one stays, whatever their other columns hold.
    """
    return near_dup.drop_near(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources' words follow their weights.

    A null source is a source; rows that repeat a doc_id within a source are taken equally often.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    return bpe.encode_digests(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dup", near_copies),
    ("source_mixing", source_mixing),
    ("bpe_codec", token_ids),
]

#: Near duplicates and BPE are beyond SQL: tests/llm compares ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; each result goes through the checkpoint folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
