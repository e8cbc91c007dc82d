"""The training-data pipeline over documents: score, strip, deduplicate, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from strataloom.llm.shared import table, written

#: Percent of common 5-word shingles from which documents are near copies.
SIMILARITY = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on the labelled ones among docs.

    Null or empty text is scored as an empty one. Repeated rows are scored alike, each for itself; rows
    of unlabelled or null doc_id are scored but teach nothing. All columns stay. Empty table: empty.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a large share of their source's documents carry.

    Null text stays null, a text all of whose lines go is empty, and its row stays. Null source is a
    source; repeated rows are pages of their own. Columns of any name stay, in order. Empty table: empty.
    """
    return line_dedup.without_boilerplate(docs).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id (of equals the least hash of text, then of all columns).

    Texts without words, null ones too, all stay. Rows that share a doc_id but no text are documents of
    their own; a null doc_id comes after all others. Columns of any name stay. Empty table: empty.
    """
    return near_dedup.deduplicated(docs, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark text is found in.

    Null or empty text holds none. Each row is judged for itself, repeated ids too. All columns stay, but
    for item_id, coverage, n_items and contaminated, which the search itself names. Empty table: empty.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, target, copies and taken, which replace columns of these names.

    Null or empty text is never taken; null source is a source; repeated rows are drawn each for itself,
    and reruns agree. Empty table: empty.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Learned scores, components and balanced draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written as Parquet and read again between them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
