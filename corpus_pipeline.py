"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
else they are named. An empty table gives an empty one at every stage, null ids are kept apart from one another where their
texts differ, and every stage reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, mixing, neardup, packing, substrings
from brindle.llm.queries import tokenizer_path
from brindle.llm.text import crc_mod
from brindle.staging import stage, table


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a stage that changes texts."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null and empty texts too), whose language can't be told, go; repeated rows stay.

    Languages are learned from the labels of these documents; where there are none, all documents with a letter stay.
    """
    return language.keep_identified(docs, docs.filter(crc_mod(F.col("doc_id"), 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id: five-word shingles, similarity 0.8.

    Rows are judged by id and text, so rows of one id, or of none, with different texts all stay; of rows that repeat both one
    stays. Null, empty and blank texts are linked with nothing.
    """
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 20-word windows that stand earlier as well go; ``n_chars`` follows the texts.

    Every row stays, with an empty text if all its words go. Null texts stay null; rows of one id stand in the order of their
    texts' hashes, and rows that repeat both id and text count as one and are cut alike.
    """
    return _measured(substrings.remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target shares; ``n_chars`` follows the texts.

    Documents without words are kept once. Null sources are one source, the last. Repeats keep their document's id: packing
    tells them apart by ``copy``.
    """
    return _measured(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096: one row per piece. Null and empty texts have their end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a staged table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
