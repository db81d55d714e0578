"""Duplicates, editions and the document registry. Tables are values: every change is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def copies(files: DataFrame, digest: str = "sha256", name: str = "name") -> DataFrame:
    """duplicate_of: the canonically named copy of the same bytes (no download suffix, shorter, then by name), else null.

    The best name per digest is an aggregate with partial sums; no group of copies is gathered.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    rank = F.struct(stem.rlike(r"\(\d+\)\s*$").cast("int").alias("suffix"), F.length(stem).alias("n"), F.lower(stem).alias("lower"), F.col(name).alias("name"))
    best = files.groupBy(digest).agg(F.min(rank).alias("__best"))
    out = files.join(best, digest, "left")  # a file without a digest is no copy
    return out.withColumn("duplicate_of", F.when(F.col("__best.name") != F.col(name), F.col("__best.name"))).drop("__best")


def families(docs: DataFrame) -> DataFrame:
    """Families of over one document, with their years newest first (unknown as 0, last), one per document.

    Documents are counted per year before a family's few years meet.
    """
    per_year = docs.where("policy_family <> ''").groupBy("policy_family", F.coalesce("year", F.lit(0)).alias("year")).agg(F.count("*").cast("int").alias("k"))
    listed = F.sort_array(F.collect_list(F.struct("year", "k")), asc=False)
    years = F.flatten(F.transform(listed, lambda y: F.array_repeat(y["year"], y["k"])))
    return per_year.groupBy("policy_family").agg(F.sum("k").alias("n"), years.alias("years")).where("n > 1")


def other_vintage(docs: DataFrame) -> DataFrame:
    """Whether another document has the same (non-empty) family."""
    shared = docs.where("policy_family <> ''").groupBy("policy_family").agg((F.count("*") > 1).alias("has_other_vintage"))
    return docs.join(shared, "policy_family", "left").withColumn("has_other_vintage", F.coalesce("has_other_vintage", F.lit(False)))


def listing(docs: DataFrame, status: str | None = None) -> DataFrame:
    out = docs if status is None else docs.where(F.col("status") == status)
    return out.orderBy("policy_family", F.col("year").desc_nulls_last(), "title", "doc_id")


def openers(docs: DataFrame, most: int = 4) -> DataFrame:
    """The largest documents, one of each family."""
    family = F.coalesce(F.nullif("policy_family", F.lit("")), F.col("doc_id"))
    best = docs.groupBy(family.alias("family")).agg(F.max(F.struct(F.col("chunks").alias("chunks"), F.col("doc_id").alias("doc_id"))).alias("b"))
    return best.select("family", "b.doc_id", "b.chunks").orderBy(F.desc("chunks"), F.desc("doc_id")).limit(most)


def upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """new replaces old by doc_id; created_at stays that of the first version."""
    kept = old.join(new.select("doc_id"), "doc_id", "left_anti")
    first = old.select("doc_id", F.col("created_at").alias("__first"))
    fresh = new.join(first, "doc_id", "left").withColumn("created_at", F.coalesce("__first", now)).withColumn("updated_at", now).drop("__first")
    return kept.unionByName(fresh.select(*kept.columns))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the documents in new give way to new: chunks, vectors and postings alike, so nothing stale stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows of no document in gone: deletion, and the view of readers while tombstones wait for compaction."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def unfinished(docs: DataFrame) -> DataFrame:
    return docs.where("status = 'deleting'").select("doc_id")


def embedder_decision(stored: Column, current: Column, vectors: Column, reset: Column) -> Column:
    """ok, stamp, refuse or rebuild: vectors of two embedders never mix."""
    return (
        F.when(reset & ((stored != current) | stored.isNull()), "rebuild")
        .when(stored == current, "ok")
        .when(stored.isNull() & (vectors == 0), "stamp")
        .otherwise("refuse")
    )


def with_identifiers(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The additive migration: each chunk gets its document's circular, '' where there is none."""
    return chunks.join(docs.select("doc_id", F.col("circular").alias("identifiers")), "doc_id", "left").withColumn("identifiers", F.coalesce("identifiers", F.lit("")))


def usable_pages(records: DataFrame, version: int) -> DataFrame:
    """Cached pages that need no new extraction."""
    said = (F.col("strategy") == "skip") | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return records.where((F.col("extractor_version") == version) & (F.coalesce("error", F.lit("")) == "") & ~F.col("deferred") & said)


def pages_to_do(pages: DataFrame, records: DataFrame, version: int) -> DataFrame:
    """Pages (sha256, page) without a usable record."""
    return pages.join(usable_pages(records, version).select("sha256", "page").distinct(), ["sha256", "page"], "left_anti")


def latest_jobs(events: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """The last state of each job, newest job first, ``most`` of them at most."""
    last = events.groupBy(key).agg(F.max(F.struct(*order, "state")).alias("last"), F.count("*").alias("n_events"))
    out = last.select(key, *(F.col(f"last.{c}").alias(c) for c in [*order, "state"]), "n_events")
    return out if most is None else out.orderBy(*(F.desc(c) for c in order), key).limit(most)


def upload_verdict(length: Column, head: Column, known: Column, limit: int) -> Column:
    """HTTP-like code of an upload: 400 empty, 413 too large, 415 no PDF, 409 known name, else 202."""
    return F.when(length == 0, 400).when(length > limit, 413).when(F.substring(head, 1, 5) != F.lit("%PDF-"), 415).when(known, 409).otherwise(202)


def by_id(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The documents of the asked ids (doc_id); unknown ids have no row."""
    return docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def by_hash(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """sha256, doc_id of each asked hash: the least id where several documents have it, null where none has."""
    known = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return hashes.select("sha256").distinct().join(known, "sha256", "left")


def vintages(docs: DataFrame, family: str) -> DataFrame:
    """The editions of a family, newest first, unknown years last."""
    return docs.where(F.col("policy_family") == family).orderBy(F.col("year").desc_nulls_last(), "doc_id")


def set_status(docs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """docs with the changes (doc_id, status, error) taken over; of several changes of a document the last by ``seq``."""
    last = changes.groupBy("doc_id").agg(F.max(F.struct("seq", F.col("status").alias("to"), F.col("error").alias("why"))).alias("c"))
    out = docs.join(last, "doc_id", "left")
    hit = F.col("c").isNotNull()
    told = out.withColumns({"status": F.when(hit, F.col("c.to")).otherwise(F.col("status")), "error": F.when(hit, F.col("c.why")).otherwise(F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return told.drop("c").select(*docs.columns)


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks of every document, without chunks too."""
    return docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def health(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, those ready, chunks."""
    return docs.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready")).join(chunks.agg(F.count("*").alias("chunks")))


def job_lists(jobs: DataFrame, finished: int = 3) -> DataFrame:
    """Jobs (job, state, seq) with ``list``: all that run, and the last ``finished`` that ended otherwise than ready."""
    running = jobs.where(~F.col("state").isin("ready", "failed", "duplicate")).withColumn("list", F.lit("running"))
    ended = jobs.where(F.col("state").isin("failed", "duplicate")).orderBy(F.desc("seq"), "job").limit(finished).withColumn("list", F.lit("ended"))
    return running.unionByName(ended)


def recorded_hashes(docs: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, sha256: the hash that a document's page records state, null where there are none."""
    stated = records.groupBy(F.col("document").alias("doc_id")).agg(F.max("sha256").alias("sha256"))
    return docs.select("doc_id").join(stated, "doc_id", "left")
