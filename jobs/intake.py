"""Intake: registers the documents of new files, so that later steps know what to index.

    python -m jobs.intake --documents PATH --register PATH --checkpoint PATH [--config FILE]

Each run takes the files that its checkpoint has not seen (a file stream that ends by itself), measures every new document,
and writes one row of the register for it: how well its text reads, its size, its digest and a state.

    failed      without an id, or without text
    duplicate   its text stands already under another id (``duplicate_of``)
    unreadable  the text reads as noise: it waits for OCR
    ready       to be indexed

Of equal texts the one registered first stays, of one batch that with the least id. A document that comes again with another
text replaces what the register says of it; documents that were its duplicates are then judged again in the same batch.
Of rows of one batch with one id that with the largest digest counts; rows without an id count once for each text.

The register is Parquet, partitioned by batch and state. A batch writes its own folder, overwriting it, and reads only those
before it, so one that breaks off and runs again leaves nothing twice, and a run without new files changes nothing.
``current`` reads the register: the newest row of each document.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens, strip, text_quality

log = logging.getLogger("jobs.intake")
CONFIG = Path(__file__).with_suffix(".json")
FACTS = ("doc_id", "source", "lang", "sha256", "n_chars", "tokens", "quality")
SCHEMA = "doc_id long, source string, lang string, sha256 string, n_chars int, tokens int, quality double, duplicate_of long, batch long, state string"


def key() -> Column:
    """What a row of the register is about: a document, or a text without an id."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "sha256"))


def measured(docs: DataFrame) -> DataFrame:
    """The facts of docs (doc_id, text, lang, source), one row each. Texts do not travel further than this."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(text, 256).alias("sha256"), F.length(text).alias("n_chars"),
        F.when(strip(text) != "", estimate_tokens(text)).otherwise(0).alias("tokens"), F.round(text_quality(text)["score"], 6).alias("quality"),
    )
    rest = F.struct("sha256", *(c for c in FACTS if c not in ("doc_id", "sha256")))
    return facts.withColumn("key", key()).groupBy("key", "doc_id").agg(F.max(rest).alias("r")).select("doc_id", "r.*").select(*FACTS)


def newest(register: DataFrame) -> DataFrame:
    """The last row of each document."""
    row = F.struct("batch", *FACTS, "duplicate_of", "state")
    last = register.withColumn("key", key()).groupBy("key").agg(F.max_by(row, "batch").alias("r"))
    return last.select("r.*")


def judged(facts: DataFrame, before: DataFrame | None, garble: float) -> DataFrame:
    """facts with duplicate_of and state, and the rows of the register so far (``before``) whose original has changed."""
    usable = (F.col("doc_id").isNotNull()) & (F.col("tokens") > 0)
    pool, known = facts, None
    if before is not None:
        mine = facts.where("doc_id IS NOT NULL").select("doc_id", F.col("sha256").alias("__now"))
        others = before.join(mine, "doc_id", "left").where("__now IS NULL").drop("__now")
        changed = before.join(mine, "doc_id").where("sha256 <> __now").select(F.col("doc_id").alias("duplicate_of")).distinct()
        pool = facts.unionByName(others.join(changed, "duplicate_of", "left_semi").select(*FACTS))
        stay = others.where(usable & F.col("duplicate_of").isNull())
        known = stay.groupBy("sha256").agg(F.min(F.struct("batch", "doc_id")).alias("k")).select("sha256", F.col("k.doc_id").alias("earlier"))
    # Partial minima per digest: a text that a third of all documents share is no group that meets anywhere.
    first = pool.where(usable).groupBy("sha256").agg(F.min("doc_id").alias("first"))
    if known is not None:
        first = first.join(known, "sha256", "left").select("sha256", F.coalesce("earlier", "first").alias("first"))
    out = pool.join(first, "sha256", "left")
    out = out.withColumn("duplicate_of", F.when(usable & (F.col("first") != F.col("doc_id")), F.col("first"))).drop("first")
    state = F.when(~usable, "failed").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("quality") >= garble, "unreadable").otherwise("ready")
    return out.withColumn("state", state).select(*FACTS, "duplicate_of", "state")


def read_register(spark: SparkSession, register: str) -> DataFrame:
    """All rows of all batches."""
    return spark.read.schema(SCHEMA).parquet(register)


def current(spark: SparkSession, register: str) -> DataFrame:
    """The register as it stands: one row per document."""
    return newest(read_register(spark, register))


def settings(path: str | Path | None = None) -> dict:
    """The config file's values over those of the file that comes with the job."""
    own = json.loads(CONFIG.read_text())
    return own | (json.loads(Path(path).read_text()) if path else {})


def run(spark: SparkSession, documents: str, register: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new below ``documents`` (a folder or a glob), waits for the end, and returns how many rows each state got."""
    cfg = settings() | (config or {})
    columns = spark.read.parquet(documents).schema
    limits = {"maxFilesPerTrigger": cfg["max_files_per_batch"], "maxBytesPerTrigger": cfg["max_bytes_per_batch"]}
    stream = spark.readStream.schema(columns).options(**{k: v for k, v in limits.items() if v}).parquet(documents)
    wrote: dict[str, int] = {}

    def batch(docs: DataFrame, number: int) -> None:
        before = None
        if number:  # the first batch made the register
            before = newest(read_register(spark, register).where(F.col("batch") < number))
        facts = measured(docs).persist()  # small rows, used several times: texts are read once
        where = f"{register}/batch={number}"
        try:
            judged(facts, before, cfg["garble"]).hint("rebalance", "state").write.mode("overwrite").partitionBy("state").parquet(where)
        finally:
            facts.unpersist()
        counts = {r.state: r["count"] for r in read_register(spark, register).where(F.col("batch") == number).groupBy("state").count().collect()}
        for state, n in counts.items():
            wrote[state] = wrote.get(state, 0) + n
        log.info("batch %d: read new files of %s, wrote %s to %s", number, documents, counts, where)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
    read = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d rows, wrote %s", read, wrote or "nothing: no new files")
    return wrote


def main() -> None:
    args = argparse.ArgumentParser(description="Registers the documents of new files.")
    for name in ("documents", "register", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("intake").getOrCreate()
    try:
        run(spark, a.documents, a.register, a.checkpoint, settings(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
