"""The queries of this package and their DuckDB SQL, added by __spark_entry__.py where the package can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, html_crf, langid, licenses, line_rules, minhash, packing, quality_classifier, sentencepiece_codec, simhash, toxicity, whitening
from quire.llm.common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the package that ships them is asked only when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    with open(model_path or tokenizer_file("piece_bpe_32k.model"), "rb") as f:  # on the driver; broadcast from there
        return sentencepiece_codec.coded(table(spark, sf_dir, "documents"), f.read())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("found")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("word_bpe_49k.json"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.learn(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_line_rules": op4_line_rules,
    "op5_simhash": op5_simhash,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
}

ORACLES: dict[str, str] = {"op4_line_rules": line_rules.REPORT_SQL, "op12_decontamination": decontamination.SQL}
