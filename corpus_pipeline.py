"""Corpus preparation: five stages over ``documents``, each written as Parquet and reread.

quality rules -> near-duplicates -> decontamination -> secret scan -> mixing.
A stage works on all rows its predecessor kept; all but the last return the
columns of ``documents``, and the last returns what the mix takes of each row.

All stages take an empty table, texts of any length, and columns of any name beside
doc_id, text, source and n_chars, which they carry along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import contamination, lines, mixing, nearcopies, secrets
from quillspark.llm._cluster import stage, table

#: The labelling model, the similarity search and the hashed mix have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go.

    Null and wordless texts go, as they fail the base rules; repeated rows are judged each; without labels the built-in
    weights decide.
    """
    return lines.keep_content(docs, lines.fit_field(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id linked by shingles of five words at 0.8.

    Rows without an id come after all others of their group; one without a group stays.  An id that several texts share
    joins nothing.  Of rows with one id and one text the first by its columns stays; wordless texts are no group.
    """
    return nearcopies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of eight words, or windows of two items, go.

    Null texts, and items without an id or a word, hold nothing; repeated rows go or stay together.
    """
    return contamination.clean_of(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; secrets in them are replaced by a mark.

    Null texts stay null; overlapping secrets get one mark; n_chars follows the text where it changed.
    """
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document left.

    A null source is a source of its own; null texts have no size; rows that tie in key, id and size are alike.
    """
    return mixing.mix(docs).drop("source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("remove_secrets", remove_secrets),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
