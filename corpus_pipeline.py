"""A pipeline over ``documents``: each stage is one of the text operators.

A stage gets the documents its predecessor kept and its result is written to the shared
folder as Parquet before the next stage reads it.  That folder stays until the shared one is
cleaned, as the result is read from it.  All stages use whole texts, however long, treat null
as the empty text, keep further columns whatever their names, and give no rows for an empty
table; what each does with ties and repeated rows is said by its operator.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, decontaminate, line_dedup, perplexity, simhash
from strandloom.llm.catalog import BYTE_BPE
from strandloom.llm.common import read
from strandloom.staging import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model does not reject.

    Null and empty texts have nothing to reject and stay; repeated rows are judged alike.
    """
    return perplexity.drop_rejected(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return line_dedup.drop_repeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number and hash of its token ids, and hash of the text decoded from them."""
    return bpe.Bpe(public_tokenizers.path(BYTE_BPE)).round_trip(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

# A language model and content-defined chunks have no SQL; tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/strandloom/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
