"""The corpus pipeline: documents through the stages in order, each stage's output written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import exact_dedup, langid, mixing, pieces, simhash
from trackframe.llm.common import shipped, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or unlike every learned language go."""
    return langid.identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays (4-word shingles, at most 4 bits)."""
    return simhash.deduplicated(docs, width=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; they are written in the order of the mix."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, in the order of the mix and with their ``position`` in it: files are read in any
    order, so the places are worked out again from the rows."""
    return pieces.encode(mixing.placed(docs))


STAGES = [(name, shipped(stage)) for name, stage in (
    ("language ID", identify_language), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources), ("SentencePiece", encode_pieces))]
ORACLE_SQL = None  # learned models and hash-ordered choices: tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs
