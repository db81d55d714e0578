"""Auditing extracted pages."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions.text import count_of, strip, table_runs

#: Warnings that mean the page was not read, unless it was recovered.
FATAL = ("returned only an image placeholder", "repetition loop", "empty output")


def warning_severity(warning: Column) -> Column:
    low = F.lower(warning)
    fatal = F.lit(False)
    for marker in FATAL:
        fatal = fatal | low.contains(marker)
    return F.when(fatal & ~low.contains("recovered"), "error").otherwise("warning")


def findings(records: DataFrame) -> DataFrame:
    """document, page, severity, check, detail: one row per finding. A page not read has that finding alone."""
    text = F.coalesce("text", F.lit(""))
    error = F.coalesce("error", F.lit(""))

    def found(holds: Column, severity: Column | str, check: str, detail: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(holds, F.struct(lit(severity).alias("severity"), F.lit(check).alias("check"), lit(detail).alias("detail")))

    lost = F.col("reason").contains("holds") & F.col("reason").contains("table") & (table_runs(text) == 0)
    engine = F.transform(
        F.coalesce("warnings", F.array().cast("array<string>")),
        lambda w: F.struct(warning_severity(w).alias("severity"), F.lit("engine-warning").alias("check"), w.alias("detail")),
    )
    own = F.array(
        found(strip(text) == "", "error", "no-text", "the page is not blank but has no text"),
        found(text.rlike(r"!\[[^\]]*\]\([^)]*\)"), "error", "fabricated-image", "the text links to an image"),
        found(text.contains("�"), "warning", "encoding-damage", F.concat(count_of(text, "�").cast("string"), F.lit(" replacement characters"))),
        found(lost, "error", "table-lost", "the page holds a table, its text none"),
    )
    failed = F.array(found(F.lit(True), "error", "extraction-failed", F.left(error, F.lit(160))))
    waiting = F.array(found(F.lit(True), "error", "never-extracted", "needs OCR"))
    all_of = F.when(error != "", failed).when(F.col("deferred"), waiting).otherwise(F.concat(F.array_compact(own), engine))
    return records.where("strategy <> 'skip'").select("document", "page", F.explode(all_of).alias("f")).select("document", "page", "f.*")


def summary(found: DataFrame, shown: int = 3) -> DataFrame:
    """Findings per severity and check, errors first, with how many stay unshown."""
    out = found.groupBy("severity", "check").agg(F.count("*").alias("n"))
    out = out.withColumn("unshown", F.greatest(F.lit(0), F.col("n") - shown))
    return out.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), F.desc("n"), "check")


def shown(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings of each severity and check."""
    w = Window.partitionBy("severity", "check").orderBy("document", "page", "detail")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word-level matching ratio of two readings of a page; null unless the first has 60 words and the second any."""

    def words(t: str | None) -> list[str]:
        return re.findall("[0-9a-z]+", (t or "").lower())

    def one(x: str | None, y: str | None) -> float | None:
        theirs, ours = words(x), words(y)
        if len(theirs) < 60 or not ours:
            return None
        return 1.0 if theirs == ours else difflib.SequenceMatcher(None, theirs, ours).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def prior_findings(records: DataFrame, prior: DataFrame, least: float = 0.55) -> DataFrame:
    """The finding ``disagrees-with-prior-ocr`` of each record (document, page, text) whose page had a text layer (document,
    page, prior) that reads otherwise."""
    both = records.join(prior.select("document", "page", "prior"), ["document", "page"]).withColumn("share", agreement("prior", "text"))
    told = F.format_string("agrees with the page's own text layer in %d %% of words", F.round(F.col("share") * 100).cast("int"))
    return both.where(F.col("share") < least).select("document", "page", F.lit("warning").alias("severity"), F.lit("disagrees-with-prior-ocr").alias("check"), told.alias("detail"))


def report(records: DataFrame, found: DataFrame) -> DataFrame:
    """One row: pages, pages without a finding, errors, warnings, documents with an error."""
    pages = records.where("strategy <> 'skip'").select("document", "page").distinct()
    marked = found.select("document", "page").distinct()
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct(F.when(F.col("severity") == "error", F.col("document"))).alias("documents_with_errors"))
    return pages.agg(F.count("*").alias("pages")).join(pages.join(marked, ["document", "page"], "left_anti").agg(F.count("*").alias("clean_pages"))).join(counts)
