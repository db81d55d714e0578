"""Where tables that outlive a query, but not the application, are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, else the session's checkpoint folder.

    On one machine (a local master) a temporary folder stands in; on a cluster without the setting that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _made.get(context.applicationId)
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _made[context.applicationId] = tempfile.mkdtemp(prefix="quire-")
    return where.rstrip("/")
