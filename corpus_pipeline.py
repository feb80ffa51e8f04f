"""From raw documents to packed training sequences, stage by stage.

All stages take rows with nulls in any column, empty and very long texts, rows that repeat a doc_id or each other, empty
tables and columns of any name; the first four return the columns of their input. What a stage does with such rows is said in
its docstring; no text is dropped but for the reason that its stage states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.llm import line_dedup, nnpu, packing, simhash, suffix_dedup
from gaugeframe.llm._shared import shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Null and empty texts score alike; equal texts go or stay together."""
    return nnpu.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that others had before; emptied ones go.

    Rows with the same doc_id and text are one document; null, empty and wordless texts lose nothing and stay.
    """
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, five-word shingles with a Jaccard similarity of 0.8 or more.

    It is that with the smallest doc_id, null last; of rows that repeat it one stays. Texts without a word are one group.
    """
    return simhash.keep_one(docs, simhash.near_duplicates)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur more than once; emptied ones go.

    Rows with the same doc_id and text are one document; null and short texts lose nothing and stay.
    """
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null or empty text is its end token. Every row is packed."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_chunks),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("packing", packed),
]
#: The classifier, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs, to = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{name}")
        docs = spark.read.parquet(f"{to}/{name}")
    return docs
