"""The jobs as registered queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import clean_export, intake
from quire.plans.catalogue import ORACLES as CHECKED
from quire.plans.text_catalogue import LINES_SQL, TRIMMED
from quire.sources.scratch import shared_folder


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        # A file stream takes a folder or a glob; the table is a folder or a single file, and this glob is either.
        intake.run(spark, f"{sf_dir}/documents.parque[t]", f"{at}/register", f"{at}/checkpoint")
    return intake.read_register(spark, f"{at}/register")


JOB1_SQL = f"""
WITH q AS ({CHECKED["text_quality"]}),
f AS (SELECT d.doc_id, d.source, d.lang, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) AS INT) AS n_chars,
  CAST(CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN greatest(1, length(text) // 4) ELSE 0 END AS INT) AS tokens, q.score AS quality FROM documents d JOIN q USING (doc_id)),
u AS (SELECT sha256, min(doc_id) AS first FROM f WHERE tokens > 0 GROUP BY sha256),
s AS (SELECT f.*, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM f LEFT JOIN u USING (sha256))
SELECT *, CAST(0 AS BIGINT) AS batch, CASE WHEN tokens = 0 THEN 'failed' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN quality >= 0.45 THEN 'unreadable' ELSE 'ready' END AS state FROM s"""


def job2_clean_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        clean_export.run(spark, f"{sf_dir}/documents.parquet", at)
    return clean_export.read_documents(spark, at)


JOB2_SQL = rf"""
WITH n AS (SELECT doc, bare, true AS noise FROM ({CHECKED["furniture_lines"]})),
l AS (SELECT *, trim(trim({TRIMMED}, '#* ')) AS bare FROM ({LINES_SQL})),
m AS (SELECT l.*, coalesce(noise, false) AS noise FROM l LEFT JOIN n USING (doc, bare)),
t AS (SELECT page AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT noise), '') AS text, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (noise) AS INT) AS n_removed FROM m GROUP BY page),
k AS (SELECT doc_id, {{TRIMMED_LINE}} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
c AS (SELECT doc_id, count(*) AS n FROM k WHERE line <> '' GROUP BY doc_id),
r AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, line, count(*) AS n FROM k WHERE length(line) >= 12 AND NOT regexp_matches(line, '^[|\-:` \t]*$') GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, d.lang, t.text, n_lines, n_removed, CAST(CASE WHEN regexp_matches(t.text, '\S') THEN greatest(1, length(t.text) // 4) ELSE 0 END AS INT) AS tokens,
  CAST(CASE WHEN c.n >= 16 AND r.most >= 8 THEN r.most ELSE 0 END AS INT) AS loops, d.source
FROM documents d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)"""
JOB2_SQL = JOB2_SQL.replace("{TRIMMED_LINE}", TRIMMED)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_intake": job1_intake, "job2_clean_export": job2_clean_export}
ORACLES: dict[str, str] = {"job1_intake": JOB1_SQL, "job2_clean_export": JOB2_SQL}
