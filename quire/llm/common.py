"""What the operators of this package share: reading, scratch space, Arrow batches, label samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import spread

#: Rows of one Arrow batch, and text bytes that a worker handles at once.
BATCH_ROWS = 256
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts whose small file is a single split is spread over all cores."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name in ("documents", "pages") else read


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long, so Arrow batches hold few rows. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key) or 10_000) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the session's checkpoint folder if it has none.

    Only on one machine (a local master: tests, trials) a temporary folder stands in where that setting is absent; on a
    cluster a folder that the executors do not share would lose data with an executor, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="quire-checkpoint-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps that are done: Spark deletes them once the driver's garbage collection finds
    their plans gone, which on a quiet driver may be half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A computed table of few bytes a row, hinted for broadcast if it has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read from there."""
    where = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def text_map(docs: DataFrame, columns: Sequence[str], fn: Callable[[dict[str, list]], dict[str, Sequence]], schema: str) -> DataFrame:
    """``fn`` over bounded slices of ``columns`` of docs: dict of lists in, dict of equally long lists out.

    Only the named columns travel; extra columns of docs, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = fn({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, n * most // max(1, batch.nbytes)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def held_out(doc_id) -> "F.Column":
    """crc32 of the id's decimal text, mod 4, is 2. A null id is never held out (and never labelled)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled rows that are not held out, texts of at most ``max_chars``.

    The rows are those of the smallest hashes of their ids, so the sample is the same in every run. Only
    model fitting uses it; every document is scored. One label of repeated rows of an id is taken (the largest).
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # The few ids are chosen before any text moves.
    ids = marks.withColumn("h", F.xxhash64(F.col("doc_id"))).orderBy("h", "doc_id").limit(max_rows)
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(ids), "doc_id")
        .select("h", "doc_id", "text", "y").collect()
    )
    rows.sort(key=lambda r: (r.h, r.doc_id, r.text))
    return [(r.text, r.y) for r in rows]
