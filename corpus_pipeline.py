"""A corpus pipeline: language ID, toxicity, near-duplicates, packing.

Every stage reads all that its predecessor kept, as a table.  The first three return rows of
`documents`, unchanged and with whatever other columns there are; the last returns the packed pieces.
Null and empty texts, very long ones, repeated rows, repeated and null ids are documents like others
wherever a stage says nothing else; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import langid, near_dup, packing, toxicity
from tidefold.llm.common import read_table, release, written
from tidefold.llm.queries import tokenizer_file


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles.

    Texts without letters (null and empty ones too) go, as do those in none of the declared languages.
    Without any declared language all go.  Null languages and hosts say nothing; ties go to the language
    first in alphabetical order; repeated rows are judged alike.
    """
    return langid.keep_identified(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of what came in.

    Null and empty texts score as texts without features; a score of exactly 0.5 goes; without labels of
    both classes the score is the share of label 1; repeated rows score alike.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all without words.

    The smallest doc_id stays, null ones come last; of rows that repeat an id each is judged by its own
    text, and of equal ones that with the smallest hash of all columns stays.
    """
    return near_dup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    Null and empty texts are one end id; repeated rows and null ids are documents of their own; ties of
    length are placed in order of doc_id, piece and crc32.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", identified), ("toxicity", not_toxic), ("near_dup", one_of_each), ("packing", packed)]

ORACLE_SQL = None  # trained models and a packing rule; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; of the tables between stages none is left."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = written(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if k:
            release(docs)
        docs = after
    return docs
