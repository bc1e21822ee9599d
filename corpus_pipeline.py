"""A corpus pipeline: quality rules, line dedup, near dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, line_dedup, mixing, quality, similar, simhash
from millrace.llm.common import read, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. A null or unknown language is judged by the base rules alone. Repeated rows are
    judged alike; an empty table stays empty; columns of any name pass through.
    """
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; a group of near duplicates counts as one document, so that it doesn't lose its text.

    Groups are those of five-word shingles with a similarity of 0.8 or more, found before any line goes. Null text stays null. Repeated rows are one document and stay alike; an empty table stays empty; columns of any name pass through.
    """
    return line_dedup.drop_templates(docs, groups=similar.similar_documents(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays in which five-word shingles link at a similarity of 0.8 or more: the one with the smallest id.

    SimHash fingerprints within 4 bits and bands of least hashes find the candidates, whole shingle sets confirm them.
    Null and empty texts are one group. Of rows with one id one stays; rows without an id all stay. An empty table stays empty;
    columns of any name pass through.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, no document more than once.

    Null language or source is a node of its own, null text has no tokens. Rows with one id are taken alike, as are those without
    one that have the same text. An empty table stays empty; columns of any name pass through.
    """
    return mixing.mixed(docs, max_epochs=1)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for each of docs.

    Null text is empty and has no tokens; null ids stay null; an empty table stays empty.
    """
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("bpe", token_stage),
]

#: SQL cannot express the fingerprints or the merges; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
