"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined results: rows without a doc_id, or that share one, are rows like others in every stage; null texts pass toxicity by the score of no
features, are one group in near_dedup and size 0 in mixing; an empty table gives none; further columns are kept until packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import mixing, packing, pii, queries, simhash, toxicity
from scorewright.llm._store import forget, scratch, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted on the labelled documents among docs, outside the held-out fold."""
    return toxicity.reject_toxic(docs, queries.toxicity_model(docs, spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard similarity of 0.8) stays: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets."""
    return pii.mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeats included."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids that keep the mix's proportions."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:  # the stage's own tables go when its result is written
            docs = keep(written(stage(spark, before, sf_dir), name))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
