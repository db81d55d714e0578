"""Training-data pipeline: each stage reads what the one before kept and wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import line_rules, near_copies, packing, quality_classifier
from quire.llm.common import table, written
from quire.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.7 or more."""
    return quality_classifier.accepted(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def sound_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with their text as it was."""
    return line_rules.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, likeness 0.8 or more."""
    return near_copies.one_of_each(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("quality_rules", sound_lines),
    ("simhash_dedup", one_of_each_group),
    ("packing", packed_tokens),
]

#: Trained models and token ids are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage keeps is written to the shared folder, so no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
