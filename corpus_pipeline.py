"""A corpus pipeline of the numbered operators; each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import language, minhash, mixing, packing, queries, suffixes
from tracelode.session import run_folder, small_batches
from tracelode.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that the language models reject."""
    small_batches(spark)
    return language.keep_known(docs, language.learn(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates."""
    small_batches(spark)
    return minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that also start elsewhere; texts that nothing is left of go."""
    small_batches(spark)
    return suffixes.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for; a document taken in part holds the part."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("source mixing", mix),
    ("packing", pack),
]

#: The stages learn models, draw by seed and tokenise, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written below the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
