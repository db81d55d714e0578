"""More registered queries: the registry's lookups and totals, whole answers, ids and dates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.config import REFUSAL
from quire.functions.identity import uuid5
from quire.operators import answer, audit, chunking, library, pages, retrieve
from quire.plans.catalogue import LIBRARY, RECORDS_SQL, SIGNALS, derived, query, records, t
from quire.plans.text_catalogue import FINDINGS_SQL, MARKED_SQL, OVERLAP_SQL, STRICT, chunk_rows, marked, question_rows, reranked
from quire.sources.scratch import shared_folder
from quire.streaming.ingest import run_all, watched


@query("registry_by_hash", f"WITH d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT a.sha256, b.doc_id FROM (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN concat('no', sha256) ELSE sha256 END AS sha256 FROM d) a LEFT JOIN (SELECT sha256, min(doc_id) AS doc_id FROM d GROUP BY 1) b USING (sha256)")
def registry_by_hash(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return library.by_hash(docs, docs.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no"), "sha256")).otherwise(F.col("sha256")).alias("sha256")))


@query("registry_by_id", f"SELECT doc_id, title, status FROM ({LIBRARY}) WHERE CAST(doc_id AS BIGINT) % 2 = 0")
def registry_by_id(spark, d):
    lib = derived(spark, d, LIBRARY)
    asked = lib.where("CAST(doc_id AS BIGINT) % 2 = 0").select("doc_id").union(spark.createDataFrame([("unknown",)], "doc_id string"))
    return library.by_id(lib, asked).select("doc_id", "title", "status")


@query("family_editions", f"SELECT doc_id, year FROM ({LIBRARY}) WHERE policy_family = 'src1'")
def family_editions(spark, d):
    return library.vintages(derived(spark, d, LIBRARY), "src1").select("doc_id", "year")


@query(
    "status_changes",
    f"SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 4 = 0 THEN 'failed' WHEN CAST(doc_id AS BIGINT) % 4 = 1 THEN 'chunking' ELSE status END AS status, CASE WHEN CAST(doc_id AS BIGINT) % 4 = 0 THEN 'no text' ELSE '' END AS error, CASE WHEN CAST(doc_id AS BIGINT) % 4 <= 1 THEN 9 ELSE 1 END AS updated_at FROM ({LIBRARY})",
)
def status_changes(spark, d):
    docs = derived(spark, d, LIBRARY).select("doc_id", "status", F.lit("").alias("error"), F.lit(1).alias("updated_at"))
    n = F.col("doc_id").cast("long")
    first = docs.where(n % 4 <= 1).select("doc_id", F.lit("chunking").alias("status"), F.lit("").alias("error"), F.lit(1).alias("seq"))
    last = docs.where(n % 4 == 0).select("doc_id", F.lit("failed").alias("status"), F.lit("no text").alias("error"), F.lit(2).alias("seq"))
    return library.set_status(docs, first.union(last), F.lit(9))


@query("chunk_counts", f"SELECT l.doc_id, CAST(count(c.line) AS BIGINT) AS n_chunks FROM ({LIBRARY}) l LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 3 <> 0) c USING (doc_id) GROUP BY 1")
def chunk_counts(spark, d):
    chunks = t(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.split("text", "\n")))
    return library.chunk_counts(derived(spark, d, LIBRARY), chunks)


@query("health_totals", f"SELECT count(*) AS documents, count(*) FILTER (status = 'ready') AS ready, (SELECT count(*) FROM embeddings) AS chunks FROM ({LIBRARY})")
def health_totals(spark, d):
    return library.health(derived(spark, d, LIBRARY), t(spark, d, "embeddings"))


JOBS_SQL = "SELECT user_id AS job, max(event_id) AS seq, CASE max(event_id) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'ready' WHEN 3 THEN 'chunking' ELSE 'queued' END AS state FROM events GROUP BY user_id"


@query("job_lists", f"WITH j AS ({JOBS_SQL}) SELECT job, state, seq, 'running' AS list FROM j WHERE state IN ('chunking', 'queued') UNION ALL SELECT * FROM (SELECT job, state, seq, 'ended' AS list FROM j WHERE state IN ('failed', 'duplicate') ORDER BY seq DESC, job LIMIT 3)")
def job_lists(spark, d):
    last = t(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("event_id").alias("seq"))
    n = F.col("seq") % 5
    state = F.when(n == 0, "failed").when(n == 1, "duplicate").when(n == 2, "ready").when(n == 3, "chunking").otherwise("queued")
    return library.job_lists(last.select("job", state.alias("state"), "seq"))


@query("recorded_hashes", f"SELECT l.doc_id, r.sha256 FROM (SELECT DISTINCT policy_family AS doc_id FROM ({LIBRARY}) UNION ALL SELECT 'unrecorded') l LEFT JOIN (SELECT document AS doc_id, max(sha256) AS sha256 FROM ({RECORDS_SQL}) GROUP BY 1) r USING (doc_id)")
def recorded_hashes(spark, d):
    docs = derived(spark, d, LIBRARY).select(F.col("policy_family").alias("doc_id")).distinct().union(spark.createDataFrame([("unrecorded",)], "doc_id string"))
    return library.recorded_hashes(docs, records(spark, d))


@query("verify_totals", f"""WITH f AS ({FINDINGS_SQL}), p AS (SELECT DISTINCT document, page FROM ({RECORDS_SQL}) WHERE strategy <> 'skip')
SELECT (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM p ANTI JOIN f USING (document, page)) AS clean_pages, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT document) FILTER (severity = 'error') AS documents_with_errors FROM f""")
def verify_totals(spark, d):
    r = records(spark, d)
    return audit.report(r, audit.findings(r))


@query("prior_findings")
def prior_findings(spark, d):
    """Records against a text layer whose words are, for every third page, the page's own, else those of the text reversed."""
    r = records(spark, d).where("strategy <> 'skip'")
    prior = r.select("document", "page", F.when(F.col("page") % 3 == 0, F.col("text")).otherwise(F.array_join(F.reverse(F.split("text", " ")), " ")).alias("prior"))
    return audit.prior_findings(r, prior)


UUID_SQL = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END, substr(h, 18, 3), '-', substr(h, 21, 12))"


@query("vector_payload", rf"SELECT chunk_id, page, {UUID_SQL} AS point_id FROM (SELECT concat('doc:', CAST(doc_id AS VARCHAR)) AS chunk_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 9 END AS INT) AS page, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode(concat('doc:', CAST(doc_id AS VARCHAR)))) AS h FROM documents)")
def vector_payload(spark, d):
    own = F.when(F.col("doc_id") % 4 != 0, F.array((F.col("doc_id") % 9).cast("int"), F.lit(99))).otherwise(F.array().cast("array<int>"))
    chunks = t(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("chunk_id"), own.alias("pages"))
    return chunking.payload(chunks).select("chunk_id", "page", "point_id")


@query("corpus_totals", "SELECT count(DISTINCT source) AS documents, count(*) AS chunks, count(*) FILTER (doc_id % 4 = 0) AS tables, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, CAST(sum(greatest(1, length(text) // 4)) // count(*) AS BIGINT) AS mean_tokens FROM documents")
def corpus_totals(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "table").otherwise("prose").alias("kind"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return chunking.totals(rows)


@query("candidate_facts", f"SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE concat('Policy ', CAST(doc_id AS VARCHAR)) END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('C-', CAST(doc_id AS VARCHAR)) END AS circular, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS policy_family, CASE WHEN doc_id % 3 <> 0 THEN CAST(2023 + doc_id % 3 AS INT) END AS year FROM documents d")
def candidate_facts(spark, d):
    docs = t(spark, d, "documents")
    known = docs.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("Policy "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("C-"), F.col("doc_id").cast("string")).alias("circular"), F.col("source").alias("policy_family"), (2023 + F.col("doc_id") % 3).cast("int").alias("year"))
    return retrieve.with_facts(docs.select("doc_id"), known)


@query("rerank_texts", "SELECT doc_id, sha256(concat(CASE WHEN doc_id % 2 = 0 THEN concat('Policy ', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN ' · C-1' ELSE '' END, ' · ', source, chr(10)) WHEN doc_id % 3 = 0 THEN concat('C-1 · ', source, chr(10)) ELSE concat(source, chr(10)) END, text)) AS digest FROM documents")
def rerank_texts(spark, d):
    n = F.col("doc_id")
    title, circular = F.when(n % 2 == 0, F.concat(F.lit("Policy "), n.cast("string"))).otherwise(" "), F.when(n % 3 == 0, "C-1").otherwise("")
    return t(spark, d, "documents").select("doc_id", F.sha2(retrieve.rerank_text(title, circular, F.col("source"), F.col("text")), 256).alias("digest"))


@query(
    "search_stages",
    f"""WITH r AS ({OVERLAP_SQL}), m AS ({MARKED_SQL}), q AS (SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT -1, '  ' UNION ALL SELECT -2, 'zzzzqqqq'), c AS (SELECT qid, count(*) AS candidates FROM r GROUP BY 1), p AS (SELECT qid, count(*) AS passages FROM m GROUP BY 1)
SELECT qid, coalesce(candidates, 0) AS candidates, coalesce(passages, 0) AS passages, CASE WHEN trim(text) = '' THEN 'blank question' WHEN candidates IS NULL THEN 'nothing found' WHEN passages IS NULL THEN 'nothing above the threshold' END AS reason FROM q LEFT JOIN c USING (qid) LEFT JOIN p USING (qid)""",
)
def search_stages(spark, d):
    asked = question_rows(spark, d).unionByName(spark.createDataFrame([(-1, "  "), (-2, "zzzzqqqq")], "qid long, question string"))
    found = reranked(spark, d)
    return retrieve.stage_counts(asked, candidates=found, passages=retrieve.passages(found, STRICT))


@query(
    "answer_sources",
    f"SELECT m.qid, place AS n, m.chunk_id AS doc_id, CASE WHEN length(d.text) > 240 THEN concat(rtrim(left(d.text, 240), ' '), '…') ELSE d.text END AS excerpt, round(score, 4) AS score FROM ({MARKED_SQL}) m JOIN documents d ON d.doc_id = m.chunk_id",
)
def answer_sources(spark, d):
    rows = marked(spark, d, answer.SHOWN).withColumns({"title": F.concat(F.lit("Doc "), F.col("chunk_id").cast("string")), "section": F.col("policy_family"), "page": F.lit(1)})
    return answer.sources(rows).select("qid", F.col("n").cast("long").alias("n"), "doc_id", "excerpt", "score")


@query(
    "whole_answers",
    f"""WITH r AS (SELECT b.item_id AS qid, count(m.chunk_id) AS n FROM benchmark b LEFT JOIN ({MARKED_SQL}) m ON m.qid = b.item_id GROUP BY 1)
SELECT qid, CASE WHEN n = 0 THEN 'refused' WHEN qid % 5 = 0 THEN 'error' ELSE 'answered' END AS status, CASE WHEN n = 0 THEN '{REFUSAL}' WHEN qid % 5 = 0 THEN '' WHEN n >= 2 THEN 'See [1] and [2].' ELSE 'See [1] and .' END AS text, CASE WHEN n = 0 OR qid % 5 = 0 THEN '' WHEN n >= 2 THEN '1,2' ELSE '1' END AS cited FROM r""",
)
def whole_answers(spark, d):
    found = retrieve.results(question_rows(spark, d), marked(spark, d))
    said = question_rows(spark, d).select("qid", F.when(F.col("qid") % 5 == 0, " ").otherwise("See [1] and [2][77].").alias("text"))
    return answer.whole(found, said).withColumn("cited", F.array_join("cited", ","))


@query("char_density", "SELECT doc_id, round(CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE n_chars / ((595.0 * (600 + doc_id % 300)) / 5184.0) END, 9) AS density FROM documents")
def char_density(spark, d):
    height = F.when(F.col("doc_id") % 7 == 0, 0.0).otherwise((600 + F.col("doc_id") % 300).cast("double"))
    return t(spark, d, "documents").select("doc_id", F.round(pages.char_density(F.col("n_chars"), F.lit(595.0), height), 9).alias("density"))


@query("name_ids", f"SELECT source, {UUID_SQL} AS id FROM (SELECT DISTINCT source, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode(source)) AS h FROM documents)")
def name_ids(spark, d):
    return t(spark, d, "documents").select("source").distinct().select("source", uuid5(F.col("source")).alias("id"))


@query("events_by_day", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(max(ts) - min(ts) < INTERVAL 1 DAY AS BOOLEAN) AS within, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS offset_days, json_extract_string(min(props), '$.nothing') AS missing FROM events GROUP BY ALL")
def events_by_day(spark, d):
    """Dates, intervals, JSON and maps over the event stream."""
    rows = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), ((F.max("ts") - F.min("ts")) < F.expr("INTERVAL 1 DAY")).alias("within"), F.get_json_object(F.min("props"), "$.nothing").alias("missing"))
    return out.withColumn("offset_days", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long"))


@query("kinds_as_map", f"SELECT doc, CAST(count(*) FILTER (page % 2 = 0) AS BIGINT) AS even, CAST(count(*) FILTER (page % 2 = 1) AS BIGINT) AS odd FROM ({SIGNALS}) GROUP BY doc")
def kinds_as_map(spark, d):
    per = derived(spark, d, SIGNALS).groupBy("doc", F.when(F.col("page") % 2 == 0, "even").otherwise("odd").alias("k")).agg(F.count("*").alias("n"))
    m = per.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("doc", F.coalesce(F.try_element_at("m", F.lit("even")), F.lit(0)).alias("even"), F.coalesce(F.try_element_at("m", F.lit("odd")), F.lit(0)).alias("odd"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_OF = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'indexing' WHEN 'error' THEN 'failed' ELSE 'ready' END"


@query(
    "stalled_jobs",
    f"""WITH e AS (SELECT user_id AS job, {STATE_OF} AS state, ts AS at_ FROM events),
o AS (SELECT *, lag(state) OVER w AS before, row_number() OVER (PARTITION BY job ORDER BY at_ DESC, state DESC) AS back FROM e WINDOW w AS (PARTITION BY job ORDER BY at_, state))
SELECT job, state, at_ AS at FROM o WHERE before IS NULL OR before <> state
UNION ALL SELECT job, 'failed', make_timestamp((epoch_us(at_) // 1000) * 1000 + 600000000) FROM o WHERE back = 1 AND state NOT IN ('ready', 'failed', 'duplicate') AND epoch_us(at_) // 1000 + 600000 <= (SELECT epoch_us(max(at_)) // 1000 FROM e) - 60000""",
)
def stalled_jobs(spark, d):
    """The changes of state of every job (a user's events) as a stream, and the failures of those that fell silent."""
    at = f"{shared_folder(spark)}/stalled-{uuid.uuid4().hex}"
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        # A file stream takes a folder or a glob; the table is a folder or a single file, and this glob is either.
        schema = spark.read.parquet(f"{d}/events.parquet").schema
        events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("job"), F.expr(STATE_OF).alias("state"), F.col("ts").cast("timestamp").alias("at"))
        run_all(lambda: watched(events).writeStream.option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").format("parquet").trigger(availableNow=True).start())
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.parquet(f"{at}/out").select("job", "state", F.col("at").cast("timestamp_ntz").alias("at"))
