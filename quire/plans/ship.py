"""Executors get the package from the driver, so it need not be installed on them."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    made = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    sc.addPyFile(str(made))


def shipped(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str, *args, **kwargs):
        ship(spark)
        return fn(spark, sf_dir, *args, **kwargs)

    return run
