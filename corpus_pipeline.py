"""The corpus pipeline: each stage works on all its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard, linededup, packing, queries, toxicity
from corvane.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are scored like any other; repeated rows share their fate."""
    return toxicity.reject_toxic(docs, queries.table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that consist of such copies alone."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, similarity 0.8) the one of smallest id stays.

    Null, empty and blank texts are like nothing; rows that repeat an id stay or go together, and rows without an id stay.
    """
    return jaccard.keep_one(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences; a null or empty text is its end token, repeated rows are packed each for itself."""
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: SQL can't express the toxicity model or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
