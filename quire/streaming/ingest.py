"""Structured Streaming: incremental ingest with job states, and citation repair of answer streams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.identity import identity
from quire.operators import keyword
from quire.operators.chunking import chunked
from quire.sources.files import source_name

STATES = ("queued", "extracting", "chunking", "indexing", "ready", "failed", "duplicate")


def markdown_stream(spark: SparkSession, path: str) -> DataFrame:
    """New markdown files: name, sha256, markdown."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(path)
    own = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    text = F.decode("content", "UTF-8")
    return files.select(source_name(text, own).alias("name"), F.sha2("content", 256).alias("sha256"), text.alias("markdown"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, embed: Callable[[str], Column] | None = None):
    """Indexes what is new in ``source`` and ends; call again for more. ``standing`` reads the result.

    A batch writes documents, chunks, vectors (if ``embed`` is given; null where it fails) and a segment of the keyword index
    into folders of its number, overwriting them, and counts as a whole once its row in ``batches`` is written; so a batch
    that breaks off and runs again leaves nothing twice. A document that comes again replaces all that it had. What is
    written grows with the batch, not with what stands.

    Each file is a job that passes queued, extracting, chunking and indexing, each told when it begins, and ends as ready; as
    duplicate, if its bytes stand already or come twice in the batch; or as failed, if another file of the batch has its
    id, or it gives no chunk or no vector. A failed document keeps the others from nothing, and has no chunks.
    """

    def batch(files: DataFrame, number: int) -> None:
        at = lambda name: f"{target}/{name}/batch={number}"

        def told(step: int, jobs: DataFrame) -> None:
            jobs.select("name", "sha256", "state", "error").write.mode("overwrite").parquet(f"{at('jobs')}/step={step}")

        state = lambda rows, name: rows.withColumns({"state": F.lit(name), "error": F.lit("")})
        files = files.persist()
        try:
            told(0, state(files, "queued"))
            stand = standing(spark, target, "documents", number)
            first = files.groupBy("sha256").agg(F.min("name").alias("first"))
            known = files.join(first, "sha256")
            if stand is not None:
                known = known.join(stand.where("status = 'ready'").select("sha256", F.lit(True).alias("old")).distinct(), "sha256", "left")
            else:
                known = known.withColumn("old", F.lit(None).cast("boolean"))
            fresh = known.where("old IS NULL AND name = first").withColumn("i", identity(F.col("name")))
            mine = fresh.groupBy("i.doc_id").agg(F.min("name").alias("mine"))
            fresh = fresh.join(mine, F.col("i.doc_id") == mine["doc_id"]).drop("doc_id")
            new = fresh.where("name = mine").persist()
            told(1, state(new, "extracting"))
            docs = new.select("i.*", "name", "sha256", "markdown")
            told(2, state(docs, "chunking"))
            chunked(docs).write.mode("overwrite").parquet(at("chunks"))
            chunks = spark.read.parquet(at("chunks"))
            told(3, state(docs, "indexing"))
            if embed is not None:
                chunks.select("chunk_id", "doc_id", embed("text").alias("embedding")).write.mode("overwrite").parquet(at("vectors"))
                lacking = spark.read.parquet(at("vectors")).where("embedding IS NULL").select("doc_id", F.lit(True).alias("lacking")).distinct()
            else:
                lacking = docs.select("doc_id", F.lit(True).alias("lacking")).limit(0)
            made = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
            out = docs.drop("markdown").join(made, "doc_id", "left").fillna(0, ["chunks"]).join(lacking, "doc_id", "left")
            error = F.when(F.col("chunks") == 0, "no text to index").when(F.col("lacking"), "no vector").otherwise("")
            out = out.withColumn("error", error).withColumn("status", F.when(error == "", "ready").otherwise("failed")).drop("lacking")
            out.write.mode("overwrite").parquet(at("documents"))
            written = spark.read.parquet(at("documents"))
            ready = written.where("status = 'ready'").select("doc_id")
            keyword.update(chunks.join(ready, "doc_id", "left_semi").withColumn("identifiers", F.lit("")), f"{target}/postings", ("text", "section", "identifiers"), removed=written.select("doc_id"))
            same = state(known.where("old OR name <> first"), "duplicate")
            rivals = fresh.where("name <> mine").withColumns({"state": F.lit("failed"), "error": F.concat(F.lit("the batch has this id from "), "mine")})
            ends = written.withColumnRenamed("status", "state")
            parts = [x.select("name", "sha256", "state", "error") for x in (ends, same, rivals)]
            told(4, parts[0].union(parts[1]).union(parts[2]))
            spark.createDataFrame([(number,)], "done long").coalesce(1).write.mode("overwrite").parquet(at("batches"))
        finally:
            files.unpersist()

    return markdown_stream(spark, source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def _batches(spark: SparkSession, target: str, table: str, before: int | None) -> DataFrame | None:
    """The rows of a table of all batches that ended, with ``batch``; None if there is none yet."""
    try:
        done = [r.done for r in spark.read.schema("done long, batch long").parquet(f"{target}/batches").select("done").distinct().collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    done = [n for n in done if before is None or n < before]
    if not done:
        return None
    rows = spark.read.option("basePath", f"{target}/{table}").parquet(*(f"{target}/{table}/batch={n}" for n in done))
    return rows.withColumn("batch", F.col("batch").cast("long"))


def standing(spark: SparkSession, target: str, table: str, before: int | None = None) -> DataFrame | None:
    """documents, chunks or vectors as they stand: of each document the rows of its last batch, and no chunks of a failed one.

    Only what was replaced is looked up, so rows of documents that came once are not shuffled for it."""
    docs, rows = _batches(spark, target, "documents", before), _batches(spark, target, table, before)
    if rows is None:
        return None
    last = docs.groupBy("doc_id").agg(F.max("batch").alias("last"))
    stale = docs.join(last, "doc_id").where("batch < last" if table == "documents" else "batch < last OR status = 'failed'").select("doc_id", "batch").distinct()
    return rows.join(stale, ["doc_id", "batch"], "left_anti")


def jobs(spark: SparkSession, target: str) -> DataFrame:
    """(name, sha256, state, error, batch, step): every state that each file's job has passed, also of a batch that runs."""
    return spark.read.option("basePath", f"{target}/jobs").parquet(f"{target}/jobs")


HELD = re.compile(r"\[\d{0,2}$")
CITED = re.compile(r"\[(\d{1,2})\]")


def repair(carry: str, delta: str, n_sources: int) -> tuple[str, str]:
    """(text to send, text to hold): a citation cut by the end of a delta waits for the next; invented ones go."""
    text = carry + delta
    cut = HELD.search(text)
    held = text[cut.start() :] if cut else ""
    sent = text[: cut.start()] if cut else text
    return CITED.sub(lambda m: m[0] if 1 <= int(m[1]) <= n_sources else "", sent), held


def repaired(deltas: DataFrame) -> DataFrame:
    """(answer_id, seq, text) of a stream of (answer_id, seq, delta, n_sources, last): state is the held text per answer.

    Deltas of an answer that arrive together are taken in order of seq; the last one releases what is held.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            sent, carry = repair(carry, r.delta, r.n_sources)
            if r.last:
                sent, carry = sent + carry, ""
            out.append((key[0], r.seq, sent))
        if rows["last"].any():
            state.remove() if state.exists else None
        else:
            state.update((carry,))
        yield pd.DataFrame(out, columns=["answer_id", "seq", "text"])

    return deltas.groupBy("answer_id").applyInPandasWithState(step, "answer_id long, seq long, text string", "carry string", "append", GroupStateTimeout.NoTimeout)


def latest_states(events: DataFrame) -> DataFrame:
    """Last state of each job of a stream of (job, seq, state), for update mode."""
    return events.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def watched(events: DataFrame, patience: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(job, state, at) for append mode, of a stream of (job, state, at): each change of a job's state, and a ``failed`` of its
    own for a job that says nothing for ``patience`` after its last event.

    Per job its last event is kept, with a timer of event time that each event sets anew; a job that has ended, by an event
    or by its timer, leaves no state behind. An event older than the last one of its job says nothing new; one that comes
    after a job has failed by its timer opens the job again. A job's events of one batch meet in one task, as few as the
    steps of a job are.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    class Watch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "state string, at long")

        def _quiet(self) -> None:
            for when in list(self.handle.listTimers()):
                self.handle.deleteTimer(when)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seen = pd.concat(list(rows)).dropna(subset=["at"]).sort_values(["at", "state"])
            state, at = self.last.get() if self.last.exists() else (None, -1)
            out = []
            for r in seen.itertuples():
                now = r.at.as_unit("ns").value // 1_000_000
                if now >= at:
                    if r.state != state:
                        out.append((key[0], r.state, r.at))
                    state, at = r.state, now
            self._quiet()
            if state is None or state in ("ready", "failed", "duplicate"):
                self.last.clear()
            else:
                self.last.update((state, at))
                self.handle.registerTimer(at + wait)
            yield pd.DataFrame(out, columns=["job", "state", "at"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            yield pd.DataFrame([(key[0], "failed", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["job", "state", "at"])

        def close(self) -> None:
            pass

    told = events.withWatermark("at", late).groupBy("job")
    return told.transformWithStateInPandas(statefulProcessor=Watch(), outputStructType=f"job {events.schema['job'].dataType.simpleString()}, state string, at timestamp", outputMode="Append", timeMode="EventTime")


def run_all(start: Callable[[], object]) -> None:
    """Starts a query that ends by itself and waits for it."""
    start().awaitTermination()
