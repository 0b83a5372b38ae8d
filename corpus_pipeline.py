"""A training-data pipeline of five corpus operators, each stage on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm import lines, mixing, neardups, sentences, toxicity
from muxlake.llm._common import Workspace, read_table, unused


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on the labels, flags as toxic."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; ``n_chars`` follows the text.

    A document none of whose lines is left goes; one that was empty before stays.
    """
    return lines.rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least doc_id, of each class of near duplicates."""
    return neardups.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents drawn to the target weights, each once and whole.

    The budget is nine tenths of the tokens in one epoch; the document that a leaf's prefix ends
    in is kept whole.
    """
    drawn = mixing.mix(docs, share=(9, 10), max_epochs=1).select("doc_id", "dh").distinct()
    found, key = unused(docs, "mix_id"), unused(docs, "mix_key")
    drawn = drawn.select(F.col("doc_id").alias(found), F.col("dh").alias(key))
    same = docs["doc_id"].eqNullSafe(F.col(found)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key))
    return docs.join(drawn, same, "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, verified."""
    return sentences.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Classification, MinHash and tokenisation cannot be expressed in SQL; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
