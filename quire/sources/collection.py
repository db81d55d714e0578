"""A collection of vectors laid out for filtered search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY = ("policy_family", "year")


def write_vectors(vectors: DataFrame, path: str, by: Sequence[str] = BY) -> None:
    """vectors (chunk_id, doc_id, payload, embedding) as a folder for each value of ``by``, each sorted by document, so a filter
    by family and year reads no other folder, and one by document skips row groups. A large family is dealt over files.

    The folders of the values in vectors are overwritten, others stay. An empty family is none (null)."""
    dealt = vectors.hint("rebalance", *by).sortWithinPartitions(*by, "doc_id", "chunk_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: str | None = None, **only: Sequence) -> DataFrame:
    """The collection; ``only`` names columns and the values that are wanted of them."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for column, values in only.items():
        rows = rows.where(F.col(column).isin(list(values)))
    return rows
