"""The corpus pipeline: rules, line dedup, near-duplicate removal, mixing, BPE. Each stage works on all that the last kept.

All stages but the last return the columns of ``documents``. Every stage takes whole texts of any length, keeps the
values of extra columns whatever their names, and gives an empty table for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from tidemark.llm.common import Scratch, documents


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, then documents that fail: too few words, too much repetition, too much lost.

    Null and empty texts fail. Rows are judged alone, so repeated rows stay or go together.
    """
    return quality_rules.cleaned(docs)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of lines of 50 words or more that stand at an earlier place, in the order of doc_id and digest.

    A text that is then empty stays, as an empty one; null texts stay null. Rows of one doc_id and text are one document
    and lose the same lines; a null doc_id comes first.
    """
    return line_dedup.deduped(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the least doc_id (null last), then the least digest of all columns.

    Null texts are as empty, and all texts without words are one class. Rows equal in all columns leave one.
    """
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources near their target weights.

    A null source is one; null texts weigh nothing and come with the passes over their source. Rows that agree in doc_id
    and text tie; which of them is taken once more depends on nothing but their number.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each document of the mix; null texts are as empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_runs),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Near duplicates and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read back; a stage's table is emptied once the next is written."""
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES:
        table = Scratch(spark)
        docs = table.stash(stage(spark, docs, sf_dir), "stage")
        if last:
            last.clear()
        last = table
    return docs
