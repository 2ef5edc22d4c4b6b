"""From raw documents to token digests: drop toxic documents, keep one of each near-duplicate
group, redact personal data, mix sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to
the shared folder and hands what it reads back to the next. All but the last keep the
documents' columns.

In every stage a null text counts as empty and stays null, null ids and repeated rows are rows like
others, texts of any length are read whole, an empty table gives an empty one, and columns
besides those a stage reads are carried along whatever their names. What a stage does beyond
that stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daftar.llm import jaccard, mixing, pieces, pii, toxicity
from daftar.llm.queries import piece_model, table
from daftar.llm.shared import stage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject; those without a letter stay."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, one row of it.

    Rows without words and rows without an id link with nothing, and all of them stay.
    """
    return jaccard.one_of_each(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row per copy of a document that it takes.

    Documents without words take a place like others; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix, a row per row; a null text has the two ids that begin and end."""
    return pieces.round_trip(docs, pieces.load(piece_model()))


STAGES = [
    ("toxicity", toxic_out),
    ("jaccard", near_duplicates_out),
    ("pii", personal_data_out),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

# trained models and span search have no SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
