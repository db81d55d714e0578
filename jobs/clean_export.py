"""Clean export: every document without the lines that repeat all over its source.

    python -m jobs.clean_export --documents PATH --out PATH [--config FILE]

Headers, footers and notices that stand in at least ``furniture_share`` of a source's documents (their numbers blanked; three
documents at least, in sources of ``least_documents`` or more) are found per source and taken out of its documents. The rest
keeps its order. Written below ``out``, partitioned by source:

    documents   doc_id, lang, text (lines joined by one line end), n_lines, n_removed, tokens, loops (how often the text
                repeats its most repeated line, if that looks like a recogniser's loop, else 0)
    furniture   bare (the line without its marks)

A run overwrites the partitions of the sources that it reads (all, or ``sources`` of the config) and no others, so it can be
repeated, or repeated for some sources, and gives the same. Null text is empty; documents without a source, or with an
empty one, lose no line and stand in the partition of null.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import degenerate_repeat, estimate_tokens, once, strip, trim_chars
from quire.operators.structure import LINE_END, furniture, lines

log = logging.getLogger("jobs.clean_export")
CONFIG = Path(__file__).with_suffix(".json")
DOCUMENTS = "doc_id long, lang string, text string, n_lines int, n_removed int, tokens int, loops int, source string"
FURNITURE = "bare string, source string"


def bare(line: Column) -> Column:
    return strip(trim_chars(strip(line), "#* "))


def repeated(docs: DataFrame, share: float, least: int) -> DataFrame:
    """(source, bare): the lines to take out of each source's documents."""
    told = docs.where("source <> ''").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.col("text").alias("segment"))
    return furniture(lines(told), share=share, least_pages=least).select("bare", F.col("doc").alias("source"))


def cleaned(docs: DataFrame, noise: DataFrame, small: bool) -> DataFrame:
    """docs without the lines of noise (source, bare).

    A source has at most (lines of a document / share) such lines, so they travel as one array a source, and no text is
    taken apart and put together again across rows.
    """
    per = noise.groupBy("source").agg(F.collect_set("bare").alias("noises"))
    both = docs.join(F.broadcast(per) if small else per, "source", "left")
    noises = F.coalesce("noises", F.array().cast("array<string>"))
    all_lines = F.split(F.coalesce("text", F.lit("")), LINE_END)

    def told(every: Column) -> Column:
        kept = F.filter(every, lambda x: ~F.array_contains(noises, bare(x)))
        return once(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(every).alias("n_lines"), (F.size(every) - F.size(k)).alias("n_removed")))

    out = both.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", once(all_lines, told).alias("r")).select("doc_id", "lang", "source", "r.*")
    tokens = F.when(strip(F.col("text")) != "", estimate_tokens(F.col("text"))).otherwise(0)
    return out.select("doc_id", "lang", "text", "n_lines", "n_removed", tokens.alias("tokens"), degenerate_repeat(F.col("text")).alias("loops"), "source")


def put(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the sources in rows; a large source is dealt over several files."""
    rows.hint("rebalance", "source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def settings(path: str | Path | None = None) -> dict:
    """The config file's values over those of the file that comes with the job."""
    own = json.loads(CONFIG.read_text())
    return own | (json.loads(Path(path).read_text()) if path else {})


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{out}/documents")


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Exports documents to ``out``; how many documents were written, how many lines taken out."""
    cfg = settings() | (config or {})
    docs = spark.read.parquet(documents).select("doc_id", "lang", "text", "source")
    if cfg["sources"]:
        docs = docs.where(F.col("source").isin(cfg["sources"]))
    put(repeated(docs, cfg["furniture_share"], cfg["least_documents"]), f"{out}/furniture")
    noise = spark.read.schema(FURNITURE).parquet(f"{out}/furniture")
    if cfg["sources"]:
        noise = noise.where(F.col("source").isin(cfg["sources"]))
    n_noise = noise.count()
    put(cleaned(docs, noise, n_noise <= cfg["broadcast_rows"]), f"{out}/documents")
    wrote = read_documents(spark, out)
    if cfg["sources"]:
        wrote = wrote.where(F.col("source").isin(cfg["sources"]))
    n = wrote.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_removed"), F.lit(0)).alias("lines_removed")).first().asDict()
    log.info("read %s%s: %d repeated lines; wrote %s to %s", documents, f" (sources {cfg['sources']})" if cfg["sources"] else "", n_noise, n, out)
    return n


def main() -> None:
    args = argparse.ArgumentParser(description="Exports documents without the lines that repeat all over their source.")
    for name in ("documents", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("clean export").getOrCreate()
    try:
        run(spark, a.documents, a.out, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
