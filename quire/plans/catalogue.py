"""Registered queries over the driver's tables, with the DuckDB SQL that checks each.

The reference inputs of page measurement (rasters, tables, dpi) have no table of their own here; they are derived from
``documents`` by the expressions below, which Spark and the SQL checks share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.config import EXTRACTOR_VERSION, JOBS_KEPT, UPLOAD_LIMIT
from quire.functions import text as tx
from quire.functions.identity import identity
from quire.operators import library, pages
from quire.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Stand-ins for the signals of a page, one page per document of its source.
SIGNALS = """SELECT source AS doc, doc_id AS page, CAST(n_chars AS DOUBLE) / 96.7 AS char_density, CAST(doc_id % 11 AS DOUBLE) / 20 AS raster_coverage,
  CAST(doc_id % 13 AS DOUBLE) / 20 AS garble, doc_id % 17 = 0 AS has_full_page_raster, CAST(80 + (doc_id * 37) % 300 AS DOUBLE) AS raster_dpi,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS table_count, CAST(doc_id % 10 AS DOUBLE) / 10 AS table_score FROM documents"""
#: A library of one row per document: family is the source, year one of three editions.
LIBRARY = """SELECT CAST(doc_id AS STRING) AS doc_id, source AS policy_family, CAST(2023 + doc_id % 3 AS INT) AS year,
  concat('Policy ', CAST(doc_id AS STRING)) AS title, n_chars AS chunks, CASE WHEN doc_id % 7 = 0 THEN 'deleting' ELSE 'ready' END AS status FROM documents"""
#: Page records with every kind of trouble.
RECORDS = """SELECT source AS document, CAST(doc_id AS INT) AS page, CASE doc_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text-layer' WHEN 2 THEN 'both' ELSE 'skip' END AS strategy,
  CASE WHEN doc_id % 9 = 0 THEN 'holds 1 table' ELSE 'dense text' END AS reason,
  CASE WHEN doc_id % 23 = 0 THEN '  ' WHEN doc_id % 19 = 0 THEN concat('![x](http://y) ', text) WHEN doc_id % 29 = 0 THEN concat(text, '�') ELSE text END AS text,
  CASE WHEN doc_id % 31 = 0 THEN 'engine stopped' ELSE '' END AS error, doc_id % 37 = 0 AS deferred,
  CASE WHEN doc_id % 6 = 0 THEN 'Repetition loop seen' WHEN doc_id % 10 = 0 THEN 'empty output; recovered on retry' ELSE '' END AS warning,
  CAST(CASE WHEN doc_id % 12 = 0 THEN 2 ELSE 3 END AS INT) AS extractor_version, sha_of AS sha256 FROM """.replace("\\ufffd", "�")


#: Tables whose rows are long enough that a task should not have many of them.
LONG = ("documents", "pages", "conversations")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name in LONG else read


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the statements above over the documents of sf_dir."""
    select, _, _ = sql.partition(" FROM documents")
    docs = t(spark, sf_dir, "documents")
    return docs.selectExpr(*_expressions(select))


def _expressions(select: str) -> list[str]:
    """The select list of a statement, cut at its outer commas."""
    out, depth, quoted, now = [], 0, False, ""
    for ch in select.strip().removeprefix("SELECT"):
        quoted ^= ch == "'"
        depth += (not quoted) * ((ch == "(") - (ch == ")"))
        if ch == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").withColumn("sha_of", F.sha2("text", 256))
    return docs.selectExpr(*_expressions(RECORDS.rpartition(" FROM ")[0])).withColumn("warnings", F.filter(F.array("warning"), lambda w: w != ""))


RECORDS_SQL = RECORDS + "(SELECT *, sha256(text) AS sha_of FROM documents)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Pages --------------------------------------------------------------------------------------------------------------


@query(
    "text_quality",
    r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents),
b AS (SELECT doc_id, length(x) AS n, length(x) - length(regexp_replace(x, '[\x00-\x08\x0E-\x1B\x7F\x{AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g')) + length(x) - length(replace(x, '�', '')) AS broken,
  length(x) - length(regexp_replace(x, '\s', '', 'g')) AS space, length(x) - length(regexp_replace(x, '\p{L}', '', 'g')) AS letters,
  length(x) - length(regexp_replace(x, '[aeiouAEIOU]', '', 'g')) AS vowels FROM a),
c AS (SELECT doc_id, n, broken / n AS br, space / n AS sr, CASE WHEN letters > 0 THEN vowels / letters ELSE 0.0 END AS vr, letters FROM b WHERE n >= 40),
d AS (SELECT *, least(1.0, br * 20) AS pb, CASE WHEN sr >= 0.08 THEN 0.0 ELSE least(1.0, (0.08 - sr) / 0.08) END AS ps,
  CASE WHEN letters = 0 OR abs(vr - 0.38) <= 0.18 THEN 0.0 ELSE least(1.0, (abs(vr - 0.38) - 0.18) / 0.18) END AS pv FROM c)
SELECT b.doc_id, round(coalesce(greatest(pb, ps, pv), 0.0), 6) AS score, round(coalesce(br, 0.0), 6) AS broken_ratio, round(coalesce(sr, 0.0), 6) AS space_ratio, round(coalesce(vr, 0.0), 6) AS vowel_ratio,
  CASE WHEN b.n < 40 THEN 'too short to assess' WHEN greatest(pb, ps, pv) <= 0 THEN 'reads as language' WHEN greatest(pb, ps, pv) = pb THEN 'broken' WHEN greatest(pb, ps, pv) = ps THEN 'space' ELSE 'vowel' END AS reason
FROM b LEFT JOIN d USING (doc_id)""",
)
def text_quality(spark, d):
    q = t(spark, d, "documents").select("doc_id", tx.text_quality(F.col("text")).alias("q"))
    return q.select("doc_id", *(F.round(f"q.{c}", 6).alias(c) for c in ("score", "broken_ratio", "space_ratio", "vowel_ratio")), "q.reason")


def routed(spark, d):
    s = derived(spark, d, SIGNALS)
    verdict = pages.route(F.col("char_density"), F.col("raster_coverage"), F.col("garble"), F.col("has_full_page_raster"), F.col("table_count"))
    return s.withColumn("v", verdict).select("*", "v.*").drop("v")


ROUTED_SQL = f"""SELECT *, CASE rule WHEN '1' THEN 'empty' WHEN '2b' THEN 'scanned' WHEN '3' THEN 'scanned' WHEN '4' THEN 'scanned' WHEN '5' THEN 'scanned' WHEN '6' THEN 'hybrid' ELSE 'digital' END AS kind,
  CASE rule WHEN '1' THEN 'skip' WHEN '6' THEN 'both' WHEN '8' THEN 'text-layer' ELSE 'ocr' END AS strategy,
  CASE rule WHEN '2b' THEN char_density >= 3 WHEN '3' THEN true ELSE false END AS has_prior_text
FROM (SELECT *, CASE WHEN char_density < 3 AND raster_coverage < 0.2 THEN '1' WHEN has_full_page_raster THEN '2b' WHEN garble >= 0.45 THEN '3'
  WHEN char_density < 12 AND raster_coverage >= 0.2 THEN '4' WHEN char_density < 12 THEN '5' WHEN raster_coverage >= 0.2 THEN '6' WHEN table_count > 0 THEN '7' ELSE '8' END AS rule FROM ({SIGNALS}))"""
COUNTS_SQL = f"""SELECT doc, count(*) AS pages, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("digital", "scanned", "hybrid", "empty"))},
  count(*) FILTER (kind IN ('scanned', 'hybrid')) AS ocr_pages FROM ({ROUTED_SQL}) GROUP BY doc"""


@query("page_routing", f"SELECT page, kind, strategy, rule, has_prior_text FROM ({ROUTED_SQL})")
def page_routing(spark, d):
    return routed(spark, d).select("page", "kind", "strategy", "rule", "has_prior_text")


@query("routing_summary", COUNTS_SQL)
def routing_summary(spark, d):
    return pages.kind_counts(routed(spark, d), "doc")


@query(
    "routing_totals",
    f"SELECT sum(pages) AS pages, sum(ocr_pages) AS ocr_pages, round(sum(ocr_pages) / sum(pages - empty), 6) AS ocr_share FROM (SELECT pages, ocr_pages, empty FROM ({COUNTS_SQL}))",
)
def routing_totals(spark, d):
    c = pages.kind_counts(routed(spark, d), "doc")
    return c.agg(F.sum("pages").alias("pages"), F.sum("ocr_pages").alias("ocr_pages"), F.round(F.sum("ocr_pages") / F.sum(F.col("pages") - F.col("empty")), 6).alias("ocr_share"))


@query(
    "dominant_kind",
    f"SELECT doc, CASE WHEN greatest(digital, scanned, hybrid) = 0 THEN 'empty' WHEN digital >= greatest(scanned, hybrid) THEN 'digital' WHEN scanned >= hybrid THEN 'scanned' ELSE 'hybrid' END AS dominant FROM ({COUNTS_SQL})",
)
def dominant_kind(spark, d):
    return pages.dominant_kind(pages.kind_counts(routed(spark, d), "doc"), "doc")


RECTS = """SELECT doc_id AS page, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, CAST((doc_id * 7) % 500 - 20 AS DOUBLE) + k * 30 AS x0, CAST((doc_id * 11) % 700 - 15 AS DOUBLE) + k * 25 AS y0,
  CAST((doc_id * 7) % 500 - 20 AS DOUBLE) + k * 30 + (doc_id % 400) AS x1, CAST((doc_id * 11) % 700 - 15 AS DOUBLE) + k * 25 + (doc_id % 600) AS y1,
  CAST(40 + (doc_id * 13 + k * 50) % 900 AS INT) AS px_w, CAST(30 + (doc_id * 17 + k * 70) % 800 AS INT) AS px_h FROM """


def rects(spark, d):
    docs = t(spark, d, "documents").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return docs.selectExpr(*_expressions(RECTS.rpartition(" FROM ")[0]))


RECTS_SQL = RECTS + "(SELECT doc_id, unnest([0, 1, 2]) AS k FROM documents)"


@query(
    "grid_coverage",
    f"""WITH r AS ({RECTS_SQL}), c AS (SELECT page, width / 48 AS cw, height / 48 AS ch, greatest(x0, 0.0) AS a, greatest(y0, 0.0) AS b, least(x1, width) AS c, least(y1, height) AS e FROM r),
f AS (SELECT page, unnest(range(greatest(0, CAST(floor(a / cw) AS BIGINT)), least(47, CAST(floor((c - 1e-6) / cw) AS BIGINT)) + 1)) AS col, greatest(0, CAST(floor(b / ch) AS BIGINT)) AS r0, least(47, CAST(floor((e - 1e-6) / ch) AS BIGINT)) AS r1 FROM c WHERE a < c AND b < e),
g AS (SELECT page, col, unnest(range(r0, r1 + 1)) AS row FROM f),
h AS (SELECT page, count(DISTINCT row * 48 + col) AS n FROM g GROUP BY page)
SELECT p.page, round(coalesce(n, 0) / 2304.0, 6) AS coverage FROM (SELECT DISTINCT page FROM r) p LEFT JOIN h USING (page)""",
)
def grid_coverage(spark, d):
    return pages.grid_coverage(rects(spark, d), ["page"]).select("page", F.round("coverage", 6).alias("coverage"))


@query(
    "page_images",
    f"""WITH r AS ({RECTS_SQL}), s AS (SELECT *, px_w < 64 OR px_h < 64 AS small, (x1 - x0) * (y1 - y0) AS area,
  greatest(least(x1, width) - greatest(x0, 0.0), 0.0) * greatest(least(y1, height) - greatest(y0, 0.0), 0.0) / (width * height) AS seen FROM r),
b AS (SELECT page, px_w / ((x1 - x0) / 72.0) AS dpi, row_number() OVER (PARTITION BY page ORDER BY area DESC, x0, y0) AS rn FROM s WHERE NOT small AND x1 - x0 > 1)
SELECT s.page, count(*) FILTER (NOT small) AS image_count, count(*) FILTER (small) AS decorative_image_count, coalesce(round(any_value(b.dpi), 1), 0.0) AS raster_dpi,
  bool_or(NOT small AND seen >= 0.6) AS has_full_page_raster FROM s LEFT JOIN b ON s.page = b.page AND b.rn = 1 GROUP BY s.page""",
)
def page_images(spark, d):
    return pages.page_images(rects(spark, d), ["page"])


@query(
    "effective_dpi",
    f"SELECT page, CAST(greatest(150, least(300, round_even(raster_dpi, 0))) AS INT) AS dpi, round(0.6 * least(1.0, ln(1 + page % 70) / ln(60)) + 0.4 * least(1.0, (page % 8) / 5.0), 3) AS likeness FROM ({SIGNALS})",
)
def effective_dpi(spark, d):
    s = derived(spark, d, SIGNALS)
    return s.select("page", pages.effective_dpi(F.col("raster_dpi")).alias("dpi"), pages.table_likeness(F.col("page") % 70, F.col("page") % 8).alias("likeness"))


BENCH_SQL = f"""SELECT doc, page, CASE WHEN kind <> 'digital' OR garble > 0 THEN 0.0 ELSE least(char_density / 32.0, 1.0) * (1 - raster_coverage) END AS clean_digital,
  CASE WHEN kind <> 'scanned' OR NOT has_full_page_raster THEN 0.0 ELSE raster_coverage * CASE WHEN raster_dpi > 0 THEN least(raster_dpi / 300.0, 1.0) ELSE 0.3 END END AS full_scan,
  CASE WHEN raster_coverage < 0.03 OR char_density < 8 THEN 0.0 ELSE least(least(char_density / 30.0, 1.0), least(raster_coverage * 3.0, 1.0)) END AS mixed,
  CASE WHEN kind = 'empty' THEN 0.0 ELSE table_score * (0.7 + 0.3 * least(char_density / 30.0, 1.0)) END AS dense_table,
  CASE WHEN kind NOT IN ('scanned', 'hybrid') OR raster_dpi <= 0 OR raster_dpi >= 250 THEN 0.0 ELSE (250.0 - raster_dpi) / 250.0 * least(raster_coverage * 1.5, 1.0) END AS poor_scan FROM ({ROUTED_SQL})"""
_BENCH = ("clean_digital", "full_scan", "mixed", "dense_table", "poor_scan")


@query("bench_scores", f"SELECT page, {', '.join(f'round({c}, 6) AS {c}' for c in _BENCH)} FROM ({BENCH_SQL})")
def bench_scores(spark, d):
    return pages.bench_scores(routed(spark, d)).select("page", *(F.round(c, 6).alias(c) for c in _BENCH))


@query("bench_picks")
def bench_picks(spark, d):
    return pages.bench_picks(pages.bench_scores(routed(spark, d)))


# Library ------------------------------------------------------------------------------------------------------------

NAMES = "SELECT doc_id, sha256(text) AS sha256, concat('Doc ', CAST(doc_id % 1000 AS STRING), CASE WHEN doc_id % 3 = 0 THEN ' (1)' ELSE '' END, '.pdf') AS name FROM documents"


@query(
    "exact_dedupe",
    f"""WITH n AS ({NAMES}), m AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n),
r AS (SELECT *, first_value(name) OVER (PARTITION BY sha256 ORDER BY CAST(regexp_matches(stem, '\\(\\d+\\)\\s*$') AS INT), length(stem), lower(stem), name) AS best FROM m)
SELECT doc_id, name, CASE WHEN best <> name THEN best END AS duplicate_of FROM r""",
)
def exact_dedupe(spark, d):
    docs = t(spark, d, "documents").withColumn("sha256", F.sha2("text", 256))
    name = F.concat(F.lit("Doc "), (F.col("doc_id") % 1000).cast("string"), F.when(F.col("doc_id") % 3 == 0, " (1)").otherwise(""), F.lit(".pdf"))
    return library.copies(docs.select("doc_id", "sha256", name.alias("name"))).select("doc_id", "name", "duplicate_of")


_IDENTITY_SQL = r"""
SELECT name, regexp_replace(regexp_replace(lower(regexp_replace(name, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS doc_id, title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\bafpad\b', 'approval framework for policies and associated documents', 'g'), '\bbcp\b', 'business continuity', 'g'), '\bkyc\b', 'know your customer', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS policy_family, year, circular
FROM (SELECT name, circular, CAST(coalesce(nullif(issued, ''), list_extract(years, -1)) AS INT) AS year,
    trim(regexp_replace(regexp_replace(rest, '(^|[\s\-–_])(19|20)\d{2}([\s\-–_)]|$)', ' \3', 'g'), '\s{2,}', ' ', 'g'), ' -–_') AS title
  FROM (SELECT *, regexp_extract_all(rest, '(?:^|[\s\-–_])((?:19|20)\d{2})\b', 1) AS years
    FROM (SELECT name, upper(regexp_extract(stem, '(?i)^([A-Z]-[A-Z]+-\d{4}-\d+)', 1)) AS circular, regexp_extract(stem, '(?i)^[A-Z]-[A-Z]+-(\d{4})-\d+', 1) AS issued,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)^([A-Z]-[A-Z]+-(\d{4})-\d+)[-\s]*(?:Encl\.?)?\s*', ''), '(?i)\s*[-–]\s*Portal\s+version\s*', ' ', 'g'), '\s*\(\d+\)\s*$', ' '), '(?i)\s*[-–]\s*Encl\.?\s*', ' ', 'g') AS rest
      FROM (SELECT name, trim(regexp_replace(name, '\.[^.]*$', '')) AS stem FROM names))))"""


#: A file's name for each document: with a circular's number or without, an edition's year, a portal's or a download's mark.
NAMED = """SELECT concat(CASE WHEN doc_id % 4 = 0 THEN concat('A-INST-', CAST(2019 + doc_id % 6 AS STRING), '-', CAST(100 + doc_id % 50 AS STRING), CASE WHEN doc_id % 8 = 0 THEN ' Encl. ' ELSE ' - ' END) ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN 'AFPAD Policy' WHEN 1 THEN 'BCP plan' WHEN 2 THEN 'KYC Handbook' WHEN 3 THEN concat('Notes of ', source) ELSE concat('Rules_', lang) END,
  CASE doc_id % 3 WHEN 0 THEN concat(' ', CAST(2018 + doc_id % 7 AS STRING)) WHEN 1 THEN ' - Portal version' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN concat(' (', CAST(doc_id % 9 AS STRING), ')') ELSE '' END, '.pdf') AS name FROM documents"""


@query("identity_parse", f"WITH names AS ({NAMED}) {_IDENTITY_SQL}")
def identity_parse(spark, d):
    names = derived(spark, d, NAMED)
    return names.withColumn("i", identity(F.col("name"))).select("name", "i.doc_id", "i.title", "i.policy_family", "i.year", "i.circular")


@query("family_vintages", f"SELECT policy_family, count(*) AS n, CAST(list_reverse(list_sort(list(year))) AS VARCHAR) AS years FROM ({LIBRARY}) GROUP BY policy_family HAVING count(*) > 1")
def family_vintages(spark, d):
    f = library.families(derived(spark, d, LIBRARY))
    return f.select("policy_family", "n", F.concat(F.lit("["), F.array_join("years", ", "), F.lit("]")).alias("years"))


@query("other_vintage_flag", f"SELECT doc_id, count(*) OVER (PARTITION BY policy_family) > 1 AS has_other_vintage FROM ({LIBRARY})")
def other_vintage_flag(spark, d):
    return library.other_vintage(derived(spark, d, LIBRARY)).select("doc_id", "has_other_vintage")


@query("library_listing", f"SELECT doc_id, row_number() OVER (ORDER BY policy_family, year DESC NULLS LAST, title, doc_id) AS place FROM ({LIBRARY}) WHERE status = 'ready'")
def library_listing(spark, d):
    """Places in the whole order. A running number over all rows is one task's work, so it comes from counts per
    family (few) and a window within each."""
    docs = derived(spark, d, LIBRARY).where("status = 'ready'")
    before = docs.groupBy("policy_family").count().withColumn("before", F.sum("count").over(Window.orderBy("policy_family").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("policy_family").orderBy(F.col("year").desc_nulls_last(), "title", "doc_id"))
    return docs.withColumn("within", within).join(before, "policy_family").select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("place"))


@query("newest_of_family", f"SELECT doc_id, policy_family, year FROM ({LIBRARY}) WHERE policy_family = 'src0' ORDER BY year DESC, doc_id")
def newest_of_family(spark, d):
    return derived(spark, d, LIBRARY).where("policy_family = 'src0'").select("doc_id", "policy_family", "year").orderBy(F.desc("year"), "doc_id")


@query("openers", f"SELECT family, doc_id, chunks FROM (SELECT policy_family AS family, doc_id, chunks, row_number() OVER (PARTITION BY policy_family ORDER BY chunks DESC, doc_id DESC) AS rn FROM ({LIBRARY})) WHERE rn = 1 ORDER BY chunks DESC, doc_id DESC LIMIT 4")
def openers(spark, d):
    return library.openers(derived(spark, d, LIBRARY))


@query("lookup", f"SELECT a.doc_id, b.n AS chunks_of_family FROM ({LIBRARY}) a JOIN (SELECT policy_family, sum(chunks) AS n FROM ({LIBRARY}) GROUP BY 1) b USING (policy_family) WHERE a.title = 'Policy 5'")
def lookup(spark, d):
    lib = derived(spark, d, LIBRARY)
    return lib.where("title = 'Policy 5'").join(lib.groupBy("policy_family").agg(F.sum("chunks").alias("chunks_of_family")), "policy_family").select("doc_id", "chunks_of_family")


@query(
    "upsert_documents",
    f"""WITH o AS (SELECT doc_id, title, year AS created_at, year AS updated_at FROM ({LIBRARY})), n AS (SELECT concat('x', doc_id) AS doc_id, 'new' AS title FROM o WHERE created_at = 2025 UNION ALL SELECT doc_id, 'changed' FROM o WHERE created_at = 2023)
SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT n.doc_id, n.title, coalesce(o.created_at, 3000), 3000 FROM n LEFT JOIN o USING (doc_id)""",
)
def upsert_documents(spark, d):
    old = derived(spark, d, LIBRARY).select("doc_id", "title", F.col("year").alias("created_at"), F.col("year").alias("updated_at"))
    added = old.where("created_at = 2025").select(F.concat(F.lit("x"), "doc_id").alias("doc_id"), F.lit("new").alias("title"))
    new = added.union(old.where("created_at = 2023").select("doc_id", F.lit("changed").alias("title")))
    return library.upsert(old, new, F.lit(3000))


@query(
    "replace_chunks",
    "SELECT source AS doc_id, doc_id AS chunk_id, n_chars AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT source, doc_id + 1000000, n_chars * 2 FROM documents WHERE source = 'src1'",
)
def replace_chunks(spark, d):
    old = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("n"))
    new = old.where("doc_id = 'src1'").select("doc_id", (F.col("chunk_id") + 1000000).alias("chunk_id"), (F.col("n") * 2).alias("n"))
    return library.replace_rows(old, new)


@query("delete_cascade", f"SELECT CAST(d.doc_id AS STRING) AS doc_id, d.n_chars FROM documents d WHERE CAST(d.doc_id AS STRING) NOT IN (SELECT doc_id FROM ({LIBRARY}) WHERE status = 'deleting')")
def delete_cascade(spark, d):
    chunks = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "n_chars")
    return library.without(chunks, library.unfinished(derived(spark, d, LIBRARY)))


@query("unfinished_deletions", f"SELECT doc_id FROM ({LIBRARY}) WHERE status = 'deleting'")
def unfinished_deletions(spark, d):
    return library.unfinished(derived(spark, d, LIBRARY))




GUARD_ROWS = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN CAST(NULL AS STRING) WHEN doc_id % 4 = 1 THEN lang ELSE 'hashing:64' END AS s, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'hashing:64' END AS c, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS n, doc_id % 7 = 0 AS r FROM documents"


@query("embedder_guard", f"SELECT id, CASE WHEN r AND (s IS NULL OR s <> c) THEN 'rebuild' WHEN s = c THEN 'ok' WHEN s IS NULL AND n = 0 THEN 'stamp' ELSE 'refuse' END AS decision FROM ({GUARD_ROWS})")
def embedder_guard(spark, d):
    return derived(spark, d, GUARD_ROWS).select("id", library.embedder_decision(F.col("s"), F.col("c"), F.col("n"), F.col("r")).alias("decision"))


@query("migrate_identifiers", f"SELECT d.doc_id AS chunk_id, coalesce(l.circular, '') AS identifiers FROM documents d LEFT JOIN (SELECT doc_id, concat('C-', doc_id) AS circular FROM ({LIBRARY}) WHERE year = 2024) l ON CAST(d.doc_id AS STRING) = l.doc_id")
def migrate_identifiers(spark, d):
    chunks = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"))
    circulars = derived(spark, d, LIBRARY).where("year = 2024").select("doc_id", F.concat(F.lit("C-"), "doc_id").alias("circular"))
    return library.with_identifiers(chunks, circulars).select("chunk_id", "identifiers")


@query(
    "pages_to_do",
    f"WITH r AS ({RECORDS_SQL}), p AS (SELECT DISTINCT sha256, page FROM r) SELECT page FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sha256 = p.sha256 AND r.page = p.page AND extractor_version = 3 AND error = '' AND NOT deferred AND (strategy = 'skip' OR trim(text) <> ''))",
)
def pages_to_do(spark, d):
    r = records(spark, d)
    return library.pages_to_do(r.select("sha256", "page").distinct(), r, EXTRACTOR_VERSION).select("page")


@query("job_latest_state", "SELECT user_id, ts, state, n_events FROM (SELECT user_id, ts, event_type AS state, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def job_latest_state(spark, d):
    e = t(spark, d, "events").withColumn("state", F.col("event_type"))
    return library.latest_jobs(e, "user_id", ["ts", "event_id"]).select("user_id", "ts", "state", "n_events")


@query("job_history_cap", f"SELECT user_id, state FROM (SELECT user_id, ts, event_id, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 ORDER BY ts DESC, event_id DESC LIMIT {JOBS_KEPT}")
def job_history_cap(spark, d):
    e = t(spark, d, "events").withColumn("state", F.col("event_type"))
    return library.latest_jobs(e, "user_id", ["ts", "event_id"], JOBS_KEPT).select("user_id", "state")


@query("upload_validation", f"SELECT doc_id, CASE WHEN n = 0 THEN 400 WHEN n > {UPLOAD_LIMIT} THEN 413 WHEN head <> '%PDF-' THEN 415 WHEN doc_id % 8 = 0 THEN 409 ELSE 202 END AS code FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id * 400000 END AS n, CASE WHEN doc_id % 3 = 0 THEN '%PDF-' ELSE left(text, 5) END AS head FROM documents)")
def upload_validation(spark, d):
    docs = t(spark, d, "documents")
    length = F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("doc_id") * 400000)
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7").otherwise(F.left("text", F.lit(8)))
    return docs.select("doc_id", library.upload_verdict(length, head, F.col("doc_id") % 8 == 0, UPLOAD_LIMIT).alias("code"))


@query("conversation_filter", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def conversation_filter(spark, d):
    return t(spark, d, "conversations").where(F.lower("text").contains("the")).select("conv_id", "turn")
