"""More registered queries: structure, chunks, audit, retrieval, answers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.config import REFUSAL, Retrieval
from quire.functions import text as tx
from quire.functions.tokens import counts_of
from quire.functions.vectors import fingerprint, hashing_embedder
from quire.operators import answer, audit, chunking, keyword, retrieve, structure
from quire.plans.catalogue import RECORDS_SQL, derived, query, records, t
from quire.sources.collection import read_vectors, write_vectors
from quire.sources.files import markdown_of
from quire.sources.scratch import shared_folder

# Structure ----------------------------------------------------------------------------------------------------------

LINES_SQL = r"""SELECT source AS doc, doc_id AS page, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT source, doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents)"""
TRIMMED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


def doc_lines(spark, d):
    """Lines of documents, each a page of its source."""
    return structure.lines(t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.col("text").alias("segment")))


@query(
    "furniture_lines",
    f"""WITH l AS ({LINES_SQL}), b AS (SELECT DISTINCT doc, page, trim(trim({TRIMMED}, '#* ')) AS bare FROM l WHERE {TRIMMED} <> '' AND NOT starts_with({TRIMMED}, '|') AND length({TRIMMED}) <= 90),
k AS (SELECT *, trim(regexp_replace(bare, '\\d+', '#', 'g'), ' *') AS k FROM b WHERE bare <> ''), p AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source HAVING count(DISTINCT doc_id) >= 4),
c AS (SELECT doc, k, count(*) AS n FROM k GROUP BY ALL)
SELECT DISTINCT doc, bare FROM k JOIN c USING (doc, k) JOIN p USING (doc) WHERE n >= greatest(3, floor(pages * 0.02)) AND (regexp_matches(k, '[A-Za-z]') OR n >= greatest(3.0, pages * 0.6))""",
)
def furniture_lines(spark, d):
    return structure.furniture(doc_lines(spark, d), share=0.02)


@query(
    "contents_index",
    r"""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(['1.', '2.3']) AS number, unnest([0, 1]) AS pos FROM documents),
n AS (SELECT doc, rtrim(number, '.') AS number, page, pos, concat('Part ', page % 40, ' of it') AS title FROM l WHERE page % 3 <> 0)
SELECT doc, number, first(title ORDER BY page, pos) AS title FROM n GROUP BY doc, number""",
)
def contents_index(spark, d):
    docs = t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.arrays_zip(F.array(F.lit("1."), F.lit("2.3")).alias("n"), F.array(F.lit(0), F.lit(1)).alias("pos"))).alias("x"))
    tail = F.when(F.col("page") % 3 == 0, "").otherwise(" .... 12")
    made = docs.select("doc", "page", "x.pos", F.concat(F.lit("| "), "x.n", F.lit(" Part "), (F.col("page") % 40).cast("string"), F.lit(" of it"), tail).alias("line"))
    return structure.contents_index(made)


#: A pipe table per document: of two to five rows, entries of a contents list or data.
TABLE_ROWS = """SELECT doc_id, concat(CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat('| ', CAST(doc_id % 9 AS STRING), '.1 Purpose | ', CAST(doc_id % 300 AS STRING), ' |', chr(10)) END, '|---|---|', chr(10), CASE WHEN doc_id % 4 = 0 THEN '| Fee | 100 |' WHEN doc_id % 4 = 1 THEN '| Annexure A | |' ELSE concat('| 2. Scope | ... ', CAST(doc_id % 70 AS STRING), ' |') END, chr(10),
  CASE WHEN doc_id % 5 = 0 THEN concat('| 3. Three | ', lang, ' |') ELSE concat('| 3. Three | ', CAST(doc_id AS STRING), ' |') END, CASE WHEN doc_id % 7 = 0 THEN concat(chr(10), '| schedule 4 | 9 |', chr(10), '| ', source, ' | 20 |') ELSE '' END) AS body FROM documents"""


@query(
    "contents_table_flag",
    rf"""WITH r AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^|\-: ]')) AS told FROM ({TABLE_ROWS})),
c AS (SELECT doc_id, told, len(list_filter(told, lambda x: (regexp_matches(trim(string_split(trim(x, '|'), '|')[1]), '^\d+(\.\d+){{0,4}}\.?\s+\S') OR regexp_matches(trim(string_split(trim(x, '|'), '|')[1]), '(?i)^(annexure|appendix|schedule|exhibit)\b'))
  AND regexp_matches(trim(array_to_string(list_transform(string_split(trim(x, '|'), '|')[2:], lambda y: trim(y)), ' ')), '^[.\s]*\d{{0,4}}[.\s]*$'))) AS hits FROM r)
SELECT doc_id, len(told) >= 3 AND hits >= greatest(3, CAST(floor(len(told) * 0.6) AS INT)) AS is_contents FROM c""",
)
def contents_table_flag(spark, d):
    return derived(spark, d, TABLE_ROWS).select("doc_id", tx.is_contents_table(F.col("body")).alias("is_contents"))


HEADINGS = ("# Title", "## 2.1 Scope of it", "1. INTRODUCTION", "1.2.3 Risk Limits", "12 | Page", "Annexure B – Forms", "Appendix 2 Form......12", "plain prose line", "3. " + "word " * 20, "### " + "w " * 15)
_HEADED = "CASE " + " ".join(f"WHEN pos = 0 AND page % 20 = {i} THEN '{h}'" for i, h in enumerate(HEADINGS)) + " ELSE line END"


@query(
    "heading_classify",
    r"""WITH l AS (SELECT doc, page, pos, """
    + _HEADED
    + rf""" AS line FROM ({LINES_SQL})),
f AS (SELECT *, regexp_extract(line, '^\s*(#{{1,6}})\s+(\S.*?)\s*#*\s*$', 1) AS marks, regexp_extract(line, '^\s*(#{{1,6}})\s+(\S.*?)\s*#*\s*$', 2) AS atx, regexp_extract(line, '^\s*(\d+(?:\.\d+){{0,4}})\.?\s+(\S.*)$', 1) AS num, trim(regexp_extract(line, '^\s*(\d+(?:\.\d+){{0,4}})\.?\s+(\S.*)$', 2)) AS rest, trim(line, ' *') AS bare FROM l),
g AS (SELECT *, regexp_extract(atx, '^\s*(\d+(?:\.\d+){{0,4}})\.?\s+(\S.*)$', 1) AS inner_num, len(regexp_split_to_array(trim(atx), '\s+')) AS aw, len(regexp_split_to_array(rest, '\s+')) AS rw, len(regexp_split_to_array(bare, '\s+')) AS bw FROM f)
SELECT page, pos, CAST(CASE WHEN marks <> '' THEN CASE WHEN aw <= 14 THEN CASE WHEN inner_num <> '' THEN len(string_split(inner_num, '.')) ELSE length(marks) END END
  WHEN num <> '' THEN CASE WHEN regexp_matches(rest, '^[*"''“(\[]*[A-Za-z]') AND length(rest) <= 110 AND rw <= 14 THEN len(string_split(num, '.')) END
  WHEN regexp_matches(bare, '(?i)^(annexure|appendix|schedule|exhibit)\b') AND NOT regexp_matches(bare, '\.{{2,}}\s*\d{{1,4}}\s*$') AND length(bare) <= 110 AND bw <= 14 THEN 1 END AS BIGINT) AS level FROM g""",
)
def heading_classify(spark, d):
    """Every line of every document; the first of half of them is a heading or almost one."""
    lines = doc_lines(spark, d).withColumn("line", F.expr(_HEADED))
    return lines.select("page", F.col("pos").cast("long").alias("pos"), structure.heading(F.col("line"))["level"].cast("long").alias("level"))


BLOCKS = "SELECT source AS doc, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(1 + (doc_id * 7) % 4 AS INT) AS level, CAST(doc_id % 10 AS STRING) AS number, concat('T', CAST(doc_id AS STRING)) AS title FROM documents"


@query(
    "breadcrumbs",
    f"""WITH b AS ({BLOCKS}), h AS (SELECT doc, pos AS hp, level, concat(number, ' ', title) AS name FROM b WHERE kind = 'heading'),
o AS (SELECT b.doc, b.pos, h.hp, h.level, h.name FROM b JOIN h ON h.doc = b.doc AND h.hp <= b.pos),
m AS (SELECT doc, pos, hp, level, name, min(level) OVER (PARTITION BY doc, pos ORDER BY hp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM o)
SELECT b.doc, b.pos, coalesce(string_agg(m.name, ' > ' ORDER BY m.level) FILTER (later IS NULL OR m.level < later), '') AS section FROM b LEFT JOIN m USING (doc, pos) GROUP BY ALL""",
)
def breadcrumbs(spark, d):
    return structure.breadcrumbs(derived(spark, d, BLOCKS)).select("doc", "pos", "section")


PIPED = "SELECT doc_id, concat('| a | b |', chr(10), '|---|---|', chr(10), text, chr(10), '| c | d |', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('| e |', chr(10)) ELSE '' END, 'end') AS body FROM documents"


@query(
    "table_runs",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM ({PIPED})),
f AS (SELECT *, starts_with({TRIMMED}, '|') AND length(line) - length(replace(line, '|', '')) >= 2 AS is_row FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, is_row ORDER BY pos) AS grp FROM f), r AS (SELECT doc_id, grp FROM g WHERE is_row GROUP BY doc_id, grp HAVING count(*) >= 2)
SELECT d.doc_id, CAST(count(r.grp) AS INT) AS runs, CAST((SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND regexp_matches({TRIMMED}, '^\|[|\-: ]*$') AND contains(line, '---')) AS INT) AS separators FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
)
def table_runs(spark, d):
    return derived(spark, d, PIPED).select("doc_id", tx.table_runs(F.col("body")).alias("runs"), tx.separator_rows(F.col("body")).alias("separators"))


@query("strip_images", r"SELECT doc_id, sha256(regexp_replace(concat(CASE WHEN doc_id % 4 = 0 THEN '![alt](http://x/y.png)' ELSE '[link](z)' END, text), '!\[[^\]]*\]\([^)]*\)', '', 'g').regexp_replace('^\s+|\s+$', '', 'g')) AS digest FROM documents")
def strip_images(spark, d):
    body = F.concat(F.when(F.col("doc_id") % 4 == 0, "![alt](http://x/y.png)").otherwise("[link](z)"), "text")
    return t(spark, d, "documents").select("doc_id", F.sha2(tx.strip_images(body), 256).alias("digest"))


@query("unfence", r"SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN doc_id % 3 = 1 THEN text ELSE concat('```', chr(10), text) END) AS digest FROM documents")
def unfence(spark, d):
    fence = F.lit("```\n")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat(fence, "text"))
    return t(spark, d, "documents").select("doc_id", F.sha2(tx.unfence(body), 256).alias("digest"))


@query(
    "degenerate_repeat",
    rf"""WITH l AS (SELECT doc_id, {TRIMMED} AS line FROM (SELECT doc_id, unnest(string_split(concat(text, CASE WHEN doc_id % 9 = 0 THEN repeat(concat(chr(10), 'the same line again'), 20) ELSE '' END), chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, count(*) AS lines FROM l WHERE line <> '' GROUP BY doc_id), c AS (SELECT doc_id, line, count(*) AS k FROM l WHERE length(line) >= 12 AND NOT regexp_matches(line, '^[|\-:` \t]*$') GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(max(k) FILTER (lines >= 16 AND k >= 8), 0) AS INT) AS repeats FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
)
def degenerate_repeat(spark, d):
    body = F.concat("text", F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("\nthe same line again"), F.lit(20))).otherwise(""))
    return t(spark, d, "documents").select("doc_id", tx.degenerate_repeat(body).alias("repeats"))


@query(
    "page_segments",
    "SELECT doc_id AS doc, unnest([CAST(doc_id % 50 AS INT), CAST(doc_id % 50 + 1 AS INT)]) AS page, unnest([length(text) + 2, 3]) AS n FROM documents",
)
def page_segments(spark, d):
    n = F.col("doc_id") % 50
    body = F.concat(F.lit("head <!-- page "), n.cast("string"), F.lit(" | digital | text layer -->\n"), "text", F.lit("\n<!-- page "), (n + 1).cast("string"), F.lit(" | scanned | ocr -->end"))
    return structure.segments(t(spark, d, "documents").select(F.col("doc_id").alias("doc"), body.alias("markdown"))).select("doc", "page", F.length("segment").cast("long").alias("n"))


@query(
    "text_layer",
    r"""WITH b AS (SELECT doc_id // 10 AS page, CAST((doc_id * 7) % 10 AS DOUBLE) AS y, CAST(doc_id % 3 AS DOUBLE) AS x, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*\n\s*', ' ', 'g'), '\.{4,}', '...', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY y, x, t) FILTER (t <> '') AS text FROM b GROUP BY page""",
)
def text_layer(spark, d):
    b = t(spark, d, "documents").selectExpr("doc_id div 10 AS page", "CAST((doc_id * 7) % 10 AS DOUBLE) AS y", "CAST(doc_id % 3 AS DOUBLE) AS x", "text")
    return structure.text_layer(b, ["page"])


# Chunks -------------------------------------------------------------------------------------------------------------

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(\"''“])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("sentence_split", f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS n, sha256(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def sentence_split(spark, d):
    s = t(spark, d, "documents").withColumn("s", tx.sentences(F.col("text")))
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "overlap_tail",
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS s, unnest(range(len({SENTENCES}))) AS pos FROM documents),
c AS (SELECT *, sum(greatest(1, length(s) // 4)) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM s)
SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY pos) FILTER (used <= 120 OR back = 1), '') AS tail FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
)
def overlap_tail(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.overlap_tail(F.col("text"), 120).alias("tail"))


def as_markdown(spark, d):
    """Each document as a parsed one of five pages: its lines are paragraphs of the second; every fifth document has a
    heading and a table there, every third a contents page, running headers and a heading whose body runs on."""
    docs = t(spark, d, "documents")
    page = lambda n: f"<!-- page {n} | digital | text layer -->\n"
    rich = F.col("doc_id") % 3 == 0
    head = F.when(rich, "HOUSE MANUAL\n\n").otherwise("")
    body = F.concat(
        F.lit(page(1)), head, F.when(rich, "CONTENTS\n| 1 | Scope | 2 |\n| 2 | Limits | 3 |\n| 3 | Ends | 4 |\n2.1 Spending limits 3\n\n").otherwise(""),
        F.lit(page(2)), head, F.when(F.col("doc_id") % 5 == 0, "# 1 Scope\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n"),
        F.lit(page(3)), head, F.when(rich, "2.1 Spending Limits Nobody spends more than the board allows in a year.\n- item one\n**Bold words**\nplain words\nthat go on\n").otherwise(""),
        F.lit(page(4)), head, F.lit(page(5)), head,
    )
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.col("source").alias("policy_family"), (2023 + F.col("doc_id") % 3).cast("int").alias("year"), body.alias("markdown"))


@query("chunk_pack")
def chunk_pack(spark, d):
    return chunking.chunked(as_markdown(spark, d)).drop("text")


@query("chunk_pack_tokens")
def chunk_pack_tokens(spark, d, tokenizer_path=None):
    """Packs filled by the counts of a tokenizer in place of the estimate."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return chunking.chunked(as_markdown(spark, d), count=counts_of(spark, tokenizer_path)).drop("text")


def _nl(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_HEAD = "CASE WHEN doc_id % 3 = 0 THEN " + _nl("HOUSE MANUAL\n\n") + " ELSE '' END"
_CONTENTS_PAGE = "CASE WHEN doc_id % 3 = 0 THEN " + _nl("CONTENTS\n| 1 | Scope | 2 |\n| 2 | Limits | 3 |\n| 3 | Ends | 4 |\n2.1 Spending limits 3\n\n") + " ELSE '' END"
_SCOPE = "CASE WHEN doc_id % 5 = 0 THEN " + _nl("# 1 Scope\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n") + " ELSE '' END"
_LIMITS = "CASE WHEN doc_id % 3 = 0 THEN " + _nl("2.1 Spending Limits Nobody spends more than the board allows in a year.\n- item one\n**Bold words**\nplain words\nthat go on\n") + " ELSE '' END"
_N = r"^\s*(\d+(?:\.\d+){0,4})\.?\s+(\S.*)$"
_ATX = r"^\s*(#{1,6})\s+(\S.*?)\s*#*\s*$"
_WORDS_OF = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_FLAT = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
BLOCKS_SQL = rf"""WITH seg AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest([1, 2, 3, 4, 5]) AS page, unnest([concat(chr(10), {_HEAD}, {_CONTENTS_PAGE}), concat(chr(10), {_HEAD}, {_SCOPE}, replace(text, chr(10), chr(10) || chr(10)), chr(10)), concat(chr(10), {_HEAD}, {_LIMITS}), concat(chr(10), {_HEAD}), concat(chr(10), {_HEAD})]) AS segment FROM documents),
sp AS (SELECT doc, page, regexp_split_to_array(segment, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM seg),
l0 AS (SELECT doc, page, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM sp), l1 AS (SELECT doc, page, pos, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l0),
b AS (SELECT *, trim(trim(line, '#* ')) AS bare, trim(regexp_replace(trim(trim(line, '#* ')), '\d+', '#', 'g'), ' *') AS k FROM l1),
fk AS (SELECT doc, k FROM (SELECT DISTINCT doc, page, bare, k FROM b WHERE line <> '' AND NOT starts_with(line, '|') AND length(line) <= 90 AND bare <> '') GROUP BY doc, k HAVING count(*) >= 3 AND (regexp_matches(k, '[A-Za-z]') OR count(*) >= 3.0)),
kn AS (SELECT doc, number, first(title ORDER BY page, pos) AS known FROM (SELECT doc, page, pos, regexp_extract(x, '{_N}', 1) AS number, trim(regexp_replace(trim(regexp_extract(x, '{_N}', 2)), '[\s.]+\d{{1,4}}\s*$', ''), ' .…*') AS title FROM (SELECT *, trim(trim(line, '|')) AS x FROM b) WHERE regexp_matches(x, '{_N}') AND regexp_matches(trim(regexp_extract(x, '{_N}', 2)), '[\s.]+\d{{1,4}}\s*$')) WHERE title <> '' AND length(title) <= 110 GROUP BY doc, number),
f AS (SELECT b.*, fk.k IS NOT NULL AND length(b.line) <= 90 AND b.bare <> '' AS noise, regexp_extract(line, '{_ATX}', 1) AS marks, regexp_extract(line, '{_ATX}', 2) AS atx, regexp_extract(line, '{_N}', 1) AS num, trim(regexp_extract(line, '{_N}', 2)) AS rest, trim(line, ' *') AS tl, {_FLAT.format("coalesce(kn.known, '')")} AS marker
  FROM b LEFT JOIN fk ON fk.doc = b.doc AND fk.k = b.k LEFT JOIN kn ON kn.doc = b.doc AND kn.number = regexp_extract(b.raw, '{_N}', 1) AND regexp_extract(b.raw, '{_N}', 1) <> ''),
g AS (SELECT *, regexp_extract(atx, '{_N}', 1) AS inum, CASE WHEN marker <> '' AND starts_with({_FLAT.format("rest")}, marker) THEN regexp_extract(rest, concat('(?is)^([^a-z0-9]*', regexp_replace(left(marker, -1), '(.)', '\1[^a-z0-9]*', 'g'), right(marker, 1), ')(.*[a-z0-9].*)$'), 1) ELSE '' END AS cut FROM f),
h AS (SELECT *, CASE WHEN cut <> '' THEN trim(cut) ELSE rest END AS title, CASE WHEN cut <> '' AND NOT regexp_matches(trim(substr(rest, length(cut) + 1)), '^[\s.…]*\d{{1,4}}[\s.]*$') THEN trim(substr(rest, length(cut) + 1)) ELSE '' END AS after FROM g),
c AS (SELECT *, CASE WHEN starts_with(line, '|') OR noise THEN 0 WHEN marks <> '' THEN CASE WHEN {_WORDS_OF.format("atx")} <= 14 THEN 1 ELSE 0 END WHEN num <> '' THEN CASE WHEN regexp_matches(rest, '^[*"''“(\[]*[A-Za-z]') AND length(title) <= 110 AND {_WORDS_OF.format("title")} <= 14 THEN 2 ELSE 0 END
  WHEN regexp_matches(tl, '(?i)^\s*(annexure|appendix|schedule|exhibit)\b') AND NOT regexp_matches(tl, '\.{{2,}}\s*\d{{1,4}}\s*$') AND length(tl) <= 110 AND {_WORDS_OF.format("tl")} <= 14 THEN 3 ELSE 0 END AS hk FROM h),
k AS (SELECT *, CASE WHEN starts_with(line, '|') THEN 'table' WHEN line = '' OR noise THEN 'gap' WHEN regexp_matches(line, '(?i)^\s*\**\s*(table of contents|contents|index)\s*\**\s*$') THEN 'contents' WHEN hk > 0 THEN 'heading' WHEN regexp_matches(line, '^[-*•] ') OR regexp_matches(line, '^[a-z]\)\s') THEN 'list' WHEN regexp_matches(line, '^\s*\*\*(.+?)\*\*\s*$') THEN 'bold' ELSE 'paragraph' END AS kind FROM c),
r AS (SELECT *, sum(CASE WHEN kind IN ('table', 'paragraph') AND kind = before AND page = bpage THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, pos) AS run FROM (SELECT *, lag(kind) OVER w AS before, lag(page) OVER w AS bpage FROM k WINDOW w AS (PARTITION BY doc ORDER BY page, pos))),
a AS (SELECT doc, run, min(page) AS page, min(kind) AS kind, string_agg(line, chr(10) ORDER BY pos) AS ls, list(line ORDER BY pos) FILTER (regexp_matches(line, '[^|\-: ]')) AS told, string_agg(line, ' ' ORDER BY pos) AS joined, min(hk) AS hk, min(marks) AS marks, min(atx) AS atx, min(inum) AS inum, min(num) AS num, min(title) AS title, min(after) AS after, min(tl) AS tl FROM r WHERE kind <> 'gap' GROUP BY doc, run),
t AS (SELECT *, kind = 'contents' OR (kind = 'table' AND len(told) >= 3 AND len(list_filter(told, lambda x: (regexp_matches(trim(string_split(trim(x, '|'), '|')[1]), '^\d+(\.\d+){{0,4}}\.?\s+\S') OR regexp_matches(trim(string_split(trim(x, '|'), '|')[1]), '(?i)^(annexure|appendix|schedule|exhibit)\b'))
  AND regexp_matches(trim(array_to_string(list_transform(string_split(trim(x, '|'), '|')[2:], lambda y: trim(y)), ' ')), '^[.\s]*\d{{0,4}}[.\s]*$'))) >= greatest(3, CAST(floor(len(told) * 0.6) AS INT))) AS listing FROM a),
u AS (SELECT doc, run, 0 AS sub, page, CASE WHEN kind = 'bold' THEN 'paragraph' ELSE kind END AS kind, CASE kind WHEN 'table' THEN ls WHEN 'bold' THEN trim(joined, '* ') WHEN 'heading' THEN CASE hk WHEN 1 THEN atx WHEN 2 THEN joined ELSE tl END ELSE trim(joined) END AS text,
  CASE WHEN kind <> 'heading' THEN 0 WHEN hk = 1 THEN CASE WHEN inum <> '' THEN len(string_split(inum, '.')) ELSE length(marks) END WHEN hk = 2 THEN len(string_split(num, '.')) ELSE 1 END AS level, CASE WHEN kind <> 'heading' THEN '' WHEN hk = 1 THEN inum WHEN hk = 2 THEN num ELSE '' END AS number,
  CASE WHEN kind <> 'heading' THEN '' WHEN hk = 1 THEN trim(CASE WHEN inum <> '' THEN regexp_extract(atx, '{_N}', 2) ELSE atx END, ' *') WHEN hk = 2 THEN trim(title, ' *') ELSE trim(tl, ' *') END AS title, CASE WHEN kind = 'heading' AND hk = 2 THEN after ELSE '' END AS after, listing, bool_or(listing) OVER (PARTITION BY doc, page) AS listed FROM t),
v AS (SELECT doc, run, sub, page, kind, text, level, number, title, listed FROM u WHERE NOT listing UNION ALL SELECT doc, run, 1, page, 'paragraph', after, 0, '', '', listed FROM u WHERE NOT listing AND after <> ''),
w AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY run, sub) AS under, lead(kind) OVER (PARTITION BY doc ORDER BY run, sub) AS nxt FROM v),
x AS (SELECT *, kind = 'heading' AND sum(CASE WHEN kind = 'heading' THEN 0 ELSE length(text) END) OVER (PARTITION BY doc, under) < 40 AS empty FROM w),
y AS (SELECT *, bool_or(empty AND (listed OR (number <> '' AND regexp_matches(text, '[\s.]+\d{{1,4}}\s*$')) OR coalesce(nxt = 'heading', false))) OVER (PARTITION BY doc, page ORDER BY run, sub) AS entry FROM x)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY run, sub) - 1 AS INT) AS pos, kind, text, page, CAST(level AS INT) AS level, number, title FROM y WHERE NOT (empty AND entry)"""


@query("block_parse", BLOCKS_SQL)
def block_parse(spark, d):
    return structure.blocks_of(as_markdown(spark, d).withColumnRenamed("doc_id", "doc"))


@query("chunk_ids", "SELECT doc_id, concat(source, ':', left(sha256(concat(source, '|', CAST(doc_id AS VARCHAR), '|s|(', CAST(doc_id AS VARCHAR), ',)|', text)), 16)) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    one = F.array("doc_id")
    return t(spark, d, "documents").select("doc_id", chunking.chunk_id(F.col("source"), F.col("doc_id"), F.lit("s"), one, F.col("text")).alias("chunk_id"))


@query(
    "chunk_stats",
    """SELECT source AS doc_id, count(*) AS chunks, count(*) FILTER (doc_id % 4 = 0) AS tables, count(*) FILTER (CASE WHEN doc_id % 4 = 0 THEN greatest(1, length(text) // 4) > 2000 ELSE greatest(1, length(text) // 4) > 1050 END) AS oversized,
  count(DISTINCT lang) AS sections, CAST(sum(greatest(1, length(text) // 4)) // count(*) AS BIGINT) AS mean_tokens, count(*) FILTER (doc_id % 4 <> 0 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 6) AS short FROM documents GROUP BY source""",
)
def chunk_stats(spark, d):
    c = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "table").otherwise("prose").alias("kind"), tx.estimate_tokens(F.col("text")).alias("tokens"), F.col("lang").alias("section"), "text")
    return chunking.stats(c)


# Audit --------------------------------------------------------------------------------------------------------------

FINDINGS_SQL = rf"""WITH r AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, (SELECT count(*) FROM (SELECT 1) WHERE false) AS z FROM ({RECORDS_SQL}) WHERE strategy <> 'skip'),
l AS (SELECT document, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM r),
k AS (SELECT *, starts_with({TRIMMED}, '|') AND length(line) - length(replace(line, '|', '')) >= 2 AS is_row FROM l),
g AS (SELECT document, page, pos - row_number() OVER (PARTITION BY document, page, is_row ORDER BY pos) AS grp FROM k WHERE is_row QUALIFY true),
h AS (SELECT DISTINCT document, page FROM g GROUP BY document, page, grp HAVING count(*) >= 2),
ok AS (SELECT * FROM r WHERE error = '' AND NOT deferred)
SELECT document, page, 'error' AS severity, 'extraction-failed' AS "check", left(error, 160) AS detail FROM r WHERE error <> ''
UNION ALL SELECT document, page, 'error', 'never-extracted', 'needs OCR' FROM r WHERE error = '' AND deferred
UNION ALL SELECT document, page, 'error', 'no-text', 'the page is not blank but has no text' FROM ok WHERE x = ''
UNION ALL SELECT document, page, 'error', 'fabricated-image', 'the text links to an image' FROM ok WHERE regexp_matches(text, '!\[[^\]]*\]\([^)]*\)')
UNION ALL SELECT document, page, 'warning', 'encoding-damage', concat(length(text) - length(replace(text, '�', '')), ' replacement characters') FROM ok WHERE contains(text, '�')
UNION ALL SELECT document, page, 'error', 'table-lost', 'the page holds a table, its text none' FROM ok WHERE reason = 'holds 1 table' AND (document, page) NOT IN (SELECT (document, page) FROM h)
UNION ALL SELECT document, page, CASE WHEN warning = 'Repetition loop seen' THEN 'error' ELSE 'warning' END, 'engine-warning', warning FROM ok WHERE warning <> ''"""


@query("verify_findings", FINDINGS_SQL)
def verify_findings(spark, d):
    return audit.findings(records(spark, d))


@query("findings_summary", f'SELECT severity, "check", count(*) AS n, greatest(0, count(*) - 3) AS unshown FROM ({FINDINGS_SQL}) GROUP BY ALL')
def findings_summary(spark, d):
    return audit.summary(audit.findings(records(spark, d)))


@query("extraction_totals", f"SELECT count(*) AS pages, count(*) FILTER (strategy IN ('ocr', 'both')) AS ocr_pages, count(*) FILTER (error <> '') AS failed, count(*) FILTER (deferred) AS deferred, CAST(sum(length(text)) AS BIGINT) AS characters FROM ({RECORDS_SQL}) WHERE strategy <> 'skip'")
def extraction_totals(spark, d):
    return records(spark, d).where("strategy <> 'skip'").agg(
        F.count("*").alias("pages"), F.count_if(F.col("strategy").isin("ocr", "both")).alias("ocr_pages"), F.count_if(F.col("error") != "").alias("failed"), F.count_if("deferred").alias("deferred"), F.sum(F.length("text")).alias("characters")
    )


@query(
    "markdown_sink",
    f"""SELECT document, sha256(concat('<!-- source: ', document, ' -->', chr(10), chr(10), string_agg(concat('<!-- page ', CAST(page AS VARCHAR), ' | digital | text layer -->', chr(10), chr(10),
  CASE WHEN error <> '' THEN concat('> extraction failed: ', error) WHEN deferred THEN '> waits for OCR' WHEN trim(text) = '' THEN '> no text' ELSE text END), chr(10) || chr(10) ORDER BY page))) AS digest
FROM ({RECORDS_SQL}) WHERE strategy <> 'skip' GROUP BY document""",
)
def markdown_sink(spark, d):
    r = records(spark, d).withColumns({"kind": F.lit("digital"), "engine": F.lit("text layer")})
    return markdown_of(r).select("document", F.sha2("markdown", 256).alias("digest"))


@query("prior_agreement")
def prior_agreement(spark, d):
    """Agreement of a document with the next one of its source."""
    docs = t(spark, d, "documents")
    after = F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select("doc_id", "text", after.alias("after")).repartition("doc_id")  # a few sources hold all documents: pairs are dealt again
    return pairs.select("doc_id", F.round(audit.agreement("text", "after"), 6).alias("agreement"))


# Retrieval ----------------------------------------------------------------------------------------------------------


def chunk_rows(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id"), "text", F.col("source").alias("policy_family"), (2023 + F.col("doc_id") % 3).cast("int").alias("year"))


def question_rows(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


TERMS = rf"list_filter(regexp_split_to_array(translate(lower(text), '{keyword.MARKED}', '{keyword.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
TOKENS_SQL = f"SELECT doc_id AS chunk_id, unnest({TERMS}) AS term, unnest(range(len({TERMS}))) AS pos FROM documents"


@query("postings_stats", f"SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM ({TOKENS_SQL}) GROUP BY term")
def postings_stats(spark, d):
    return keyword.postings(keyword.index(chunk_rows(spark, d)))


def bm25_sql(questions: str) -> str:
    """questions: (qid, question)."""
    phrase = TERMS.replace("text", "phrase")
    return rf"""WITH tok AS MATERIALIZED ({TOKENS_SQL}), q AS (SELECT qid, unnest(list_filter(list_transform(regexp_split_to_array(replace(question, '"', ''), '\s+'), lambda w: trim(w, '.,;:!?()[]{{}}<>')), lambda w: w <> '')) AS phrase FROM ({questions})),
a AS (SELECT qid, {phrase} AS terms FROM q WHERE len({phrase}) > 0), p AS (SELECT DISTINCT terms FROM a), pt AS (SELECT array_to_string(terms, ' ') AS phrase, len(terms) AS n, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM p),
m AS (SELECT phrase, n, chunk_id, pos - i AS start, count(*) AS parts FROM tok JOIN pt USING (term) GROUP BY ALL), tf AS (SELECT phrase, chunk_id, count(*) AS tf FROM m WHERE parts = n GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM documents) AS nn, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avgdl), len_ AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY 1),
df AS (SELECT phrase, CASE WHEN ln((nn - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, s GROUP BY phrase, nn),
h AS (SELECT phrase, chunk_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tf JOIN df USING (phrase) JOIN len_ USING (chunk_id), s),
sc AS (SELECT qid, chunk_id, round(sum(part), 9) AS score FROM (SELECT qid, array_to_string(terms, ' ') AS phrase FROM a) JOIN h USING (phrase) GROUP BY ALL)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 30"""


BM25_SQL = bm25_sql("SELECT item_id AS qid, text AS question FROM benchmark")
PHRASES_SQL = "SELECT item_id AS qid, replace(text, ' ', '-') AS question FROM (SELECT item_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' ') AS text FROM benchmark)"


_WRITTEN: dict[tuple, str] = {}


def written(spark, d, what, write):
    """The folder of an index over the documents of d: made by the first query of an application that asks for it, and anew
    when the files below d have changed."""
    state = spark.read.parquet(f"{d}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, d, what, frozenset(map(tuple, state.collect())))
    if key not in _WRITTEN:
        where = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write(where)
        _WRITTEN[key] = where
    return _WRITTEN[key]


def search_index(spark, d, fields=("text",)):
    chunks = fielded(spark, d) if len(fields) > 1 else chunk_rows(spark, d)
    return keyword.open_index(spark, written(spark, d, fields, lambda where: keyword.write_index(chunks, where, fields)))


def search_vectors(spark, d, dim=256):
    """(chunk_id, embedding) of every chunk, embedded once."""
    embed = hashing_embedder(dim)
    rows = chunk_rows(spark, d).select("chunk_id", embed("text").alias("embedding"))
    return spark.read.parquet(written(spark, d, ("vectors", dim), rows.write.parquet))


def fielded(spark, d):
    """Chunks with a section and an identifier, as three fields are searched."""
    return chunk_rows(spark, d).withColumns({"section": F.concat_ws(" ", F.lit("Notes on"), "policy_family", F.lit("limits")), "identifiers": F.concat(F.lit("A-INST-"), F.col("year").cast("string"), F.lit("-"), F.col("chunk_id").cast("string"))})


def searched(spark, d, questions, stem=False, fields=("text",)):
    return keyword.bm25(search_index(spark, d, fields), questions, stem=stem)


@query("bm25_topk", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({BM25_SQL})")
def bm25_topk(spark, d):
    return searched(spark, d, question_rows(spark, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


STANDING = "(SELECT * FROM documents WHERE doc_id % 11 <> 0)"


@query("bm25_after_updates", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({BM25_SQL.replace('documents', STANDING)})")
def bm25_after_updates(spark, d):
    """A written index that has seen other texts of a fifth of the documents, then their present ones, then deletions."""
    chunks = chunk_rows(spark, d)

    def write(where):
        early = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("former words "), F.col("text"), F.lit(" former words"))).otherwise(F.col("text"))
        keyword.update(chunks.where("doc_id % 3 <> 1").withColumn("text", early), where)
        keyword.update(chunks.where("doc_id % 3 = 1 OR doc_id % 5 = 0"), where)
        keyword.update(chunks.limit(0), where, removed=chunks.where("doc_id % 11 = 0").select("doc_id"))

    at = keyword.open_index(spark, written(spark, d, "updated", write))
    return keyword.bm25(at, question_rows(spark, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_phrase", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({bm25_sql(PHRASES_SQL)})")
def bm25_phrase(spark, d):
    two = F.array_join(F.slice(F.split("question", r"\s+"), 1, 2), "-")
    return searched(spark, d, question_rows(spark, d).select("qid", two.alias("question"))).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_stemmed")
def bm25_stemmed(spark, d):
    """By stems, over text, section and identifiers with their weights."""
    return searched(spark, d, stemmed_questions(spark, d), stem=True, fields=("text", "section", "identifiers"))


def stemmed_questions(spark, d):
    """Some ask for the limits of an edition by its identifier, too."""
    asked = F.when(F.col("qid") % 3 == 0, F.concat_ws(" ", "question", F.lit("limit A-INST-2024-"))).otherwise(F.col("question"))
    return question_rows(spark, d).select("qid", asked.alias("question"))


DENSE_SQL = """SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS qid, v.vec_id AS chunk_id, v.label, q.label AS qlabel, round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(CAST(q.embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(v.embedding AS DOUBLE[]), lambda x: x * x)))), 9) AS score
  FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q {where}) QUALIFY rank <= 30"""


def vectors(spark, d):
    e = t(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding"), asked


@query("dense_topk", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({DENSE_SQL.format(where='')})")
def dense_topk(spark, d):
    v, asked = vectors(spark, d)
    return retrieve.dense(v, asked).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dense_topk_filtered", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({DENSE_SQL.format(where='WHERE v.label = q.label')})")
def dense_topk_filtered(spark, d):
    v, asked = vectors(spark, d)
    only = asked.select("qid", F.col("label").alias("doc_id"))
    return retrieve.dense_within(v, asked, only).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_collection", f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM ({DENSE_SQL.format(where='WHERE v.label = q.label AND v.vec_id % 3 = q.vec_id % 3')})")
def vector_collection(spark, d):
    """Each question within the family (the label) and year of its own row, over a collection laid out by these."""

    def write(where):
        rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("policy_family"), (2023 + F.col("vec_id") % 3).cast("int").alias("year"), "embedding")
        write_vectors(rows, where)

    at = written(spark, d, "collection", write)
    v = read_vectors(spark, at, "chunk_id long, doc_id long, embedding array<float>, policy_family string, year int")
    asked = t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").cast("string").alias("policy_family"), (2023 + F.col("vec_id") % 3).cast("int").alias("year"))
    found = retrieve.dense_within(v, asked, asked.select("qid", "policy_family", "year"), keys=("policy_family", "year"))
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("hash_embed")
def hash_embed(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing_embedder(256)("text").alias("embedding"), F.lit(fingerprint("hashing", 256)).alias("fingerprint"))


#: Two ranked lists: by vectors, and by label and id.
LISTS_SQL = f"""a AS ({DENSE_SQL.format(where="")}), b AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(v.label - q.label), v.vec_id) AS rank FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 30)"""
FUSED_SQL = f"""WITH {LISTS_SQL}, f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dense_rank, b.rank AS keyword_rank, coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0) AS fused_score
  FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.chunk_id = b.chunk_id)
SELECT *, CASE WHEN dense_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'dense' ELSE 'both' END AS found_by, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, coalesce(dense_rank, 1000000), chunk_id) AS fused_rank FROM f QUALIFY fused_rank <= 30"""


def fused_lists(spark, d):
    v, asked = vectors(spark, d)
    # Only the first 30 chunks of a label can be among a question's 30: a label's rows are cut before labels meet.
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    least = v.select("doc_id", "chunk_id").withColumn("n", F.row_number().over(w)).where("n <= 30").groupBy("doc_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
    labels = asked.select("label").distinct().join(least).select("label", F.abs(F.col("doc_id") - F.col("label")).alias("away"), F.explode("chunks").alias("chunk_id"))
    first = labels.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("away", "chunk_id"))).where("rank <= 30")
    second = asked.select("qid", "label").join(first, "label").select("qid", "chunk_id", "rank")
    return retrieve.fuse(retrieve.dense(v, asked), second)


@query("rrf_fusion", f"SELECT qid, chunk_id, round(fused_score, 9) AS fused_score, found_by, fused_rank FROM ({FUSED_SQL})")
def rrf_fusion(spark, d):
    return fused_lists(spark, d).select("qid", "chunk_id", F.round("fused_score", 9).alias("fused_score"), "found_by", F.col("fused_rank").cast("long").alias("fused_rank"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"
OVERLAP_SQL = f"""SELECT b.item_id AS qid, d.doc_id AS chunk_id, len(list_intersect({_WORDS.format("b.text")}, {_WORDS.format("d.text")})) / greatest(len({_WORDS.format("b.text")}), 1) AS score, d.source AS policy_family, CAST(2023 + d.doc_id % 3 AS INT) AS year, c.rank AS fused_rank
FROM ({BM25_SQL}) c JOIN benchmark b ON b.item_id = c.qid JOIN documents d ON d.doc_id = c.chunk_id"""
PASSAGES_SQL = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank, chunk_id) AS rank FROM ({OVERLAP_SQL}) WHERE score >= 0.5 QUALIFY rank <= 8"
MARKED_SQL = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(superseded AS INT), score DESC, rank) AS place FROM (SELECT *, coalesce(policy_family <> '' AND year < max(year) OVER (PARTITION BY qid, policy_family), false) AS superseded FROM ({PASSAGES_SQL}))"
#: The threshold of these queries: of the overlap, which scores higher than a trained reranker.
STRICT = Retrieval(min_score=0.5)


def reranked(spark, d, hits=None):
    hits = searched(spark, d, question_rows(spark, d)) if hits is None else hits
    rows = retrieve.candidates(hits.select("qid", "chunk_id", F.col("rank").alias("fused_rank")), question_rows(spark, d), chunk_rows(spark, d))
    return retrieve.scored(rows, retrieve.overlap_score(F.col("question"), F.col("text")))


@query("rerank_overlap", f"SELECT qid, chunk_id, round(score, 6) AS score FROM ({OVERLAP_SQL})")
def rerank_overlap(spark, d):
    return reranked(spark, d).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("sigmoid_squash", "SELECT vec_id, round(CASE WHEN lo < 0 OR hi > 1 THEN 1 / (1 + exp(-s)) ELSE s END, 6) AS p FROM (SELECT vec_id, label % 2 * 3.0 * CAST(embedding[1] AS DOUBLE) + 0.5 AS s, min(label % 2 * 3.0 * CAST(embedding[1] AS DOUBLE) + 0.5) OVER (PARTITION BY label) AS lo, max(label % 2 * 3.0 * CAST(embedding[1] AS DOUBLE) + 0.5) OVER (PARTITION BY label) AS hi FROM embeddings)")
def sigmoid_squash(spark, d):
    s = t(spark, d, "embeddings").select("vec_id", F.col("label").alias("qid"), (F.col("label") % 2 * 3.0 * F.get("embedding", F.lit(0)).cast("double") + 0.5).alias("s"))
    return s.select("vec_id", F.round(retrieve.probabilities(F.col("s")), 6).alias("p"))


@query("vintage_marking", f"SELECT qid, chunk_id, superseded, place FROM ({MARKED_SQL})")
def vintage_marking(spark, d):
    return marked(spark, d).select("qid", "chunk_id", "superseded", F.col("place").cast("long").alias("place"))


def marked(spark, d, shown=None):
    """``shown`` cuts texts, once they are scored, to what sources show, so no more is ranked with them."""
    found = reranked(spark, d)
    found = found if shown is None else found.withColumn("text", answer.shown_of(F.col("text"), shown))
    return retrieve.mark_vintages(retrieve.passages(found, STRICT), STRICT)


@query("refusal", f"SELECT b.item_id AS qid, count(m.chunk_id) AS passages, count(DISTINCT m.chunk_id) AS document_count, count(m.chunk_id) = 0 AS refused FROM benchmark b LEFT JOIN ({MARKED_SQL}) m ON m.qid = b.item_id GROUP BY 1")
def refusal(spark, d):
    r = retrieve.results(question_rows(spark, d), marked(spark, d))
    return r.select("qid", F.size("passages").cast("long").alias("passages"), "document_count", "refused")


def hybrid(spark, d):
    """Both searches, fused, reranked, refused under the threshold, editions marked."""
    embed = hashing_embedder(256)
    questions = question_rows(spark, d)
    hits = searched(spark, d, questions)
    near = retrieve.dense(search_vectors(spark, d), questions.select("qid", embed("question").alias("embedding")))
    both = retrieve.fuse(near, hits).select("qid", "chunk_id", F.col("fused_rank").alias("rank"))
    return retrieve.mark_vintages(retrieve.passages(reranked(spark, d, both), STRICT), STRICT)


@query("hybrid_search")
def hybrid_search(spark, d):
    return retrieve.results(question_rows(spark, d), hybrid(spark, d))


# Answers ------------------------------------------------------------------------------------------------------------


@query(
    "prompt_block",
    f"""SELECT m.qid, string_agg(concat('[', CAST(place AS VARCHAR), '] Doc ', CAST(m.chunk_id AS VARCHAR), ' (', CAST(year AS VARCHAR), ')', CASE WHEN superseded THEN ' — SUPERSEDED, a newer edition is also below' ELSE '' END,
  chr(10), '    Section: ', policy_family, chr(10), '    Page: 1', chr(10), chr(10), regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place).sha256() AS digest FROM ({MARKED_SQL}) m JOIN documents d ON d.doc_id = m.chunk_id GROUP BY m.qid""",
)
def prompt_block(spark, d):
    block = answer.passage_block(F.col("place"), F.concat(F.lit("Doc "), F.col("chunk_id").cast("string")), F.col("year"), F.col("superseded"), F.col("policy_family"), F.lit(1), F.col("text"))
    rows = marked(spark, d).select("qid", "place", block.alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda p: p["block"]), "\n\n---\n\n")
    return rows.groupBy("qid").agg(F.sha2(joined, 256).alias("digest"))


ANSWERS_SQL = "SELECT conv_id, turn, concat(text, ' [', CAST(turn % 4 AS STRING), '] and [', CAST(conv_id % 12 AS STRING), '][123]') AS body FROM conversations WHERE role = 'assistant'"


def answers(spark, d):
    c = t(spark, d, "conversations").where("role = 'assistant'")
    body = F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] and ["), (F.col("conv_id") % 12).cast("string"), F.lit("][123]"))
    return c.select("conv_id", "turn", body.alias("body"))


@query(
    "citation_audit",
    rf"""WITH a AS ({ANSWERS_SQL}), e AS (SELECT *, list_distinct(list_transform(regexp_extract_all(body, '\[(\d{{1,2}})\]', 1), lambda x: CAST(x AS INT))) AS nums FROM a)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(nums, lambda n: n BETWEEN 1 AND 8)), ',') AS cited, array_to_string(list_sort(list_filter(nums, lambda n: n NOT BETWEEN 1 AND 8)), ',') AS invented,
  array_to_string(list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda n: NOT list_contains(nums, n)), ',') AS unused, length(regexp_replace(body, '\[(0|9|0\d|[1-9]\d)\]', '', 'g')) AS clean_chars FROM e""",
)
def citation_audit(spark, d):
    a = answers(spark, d).select("conv_id", "turn", answer.audit(F.col("body"), F.lit(8)).alias("a"))
    join = lambda c: F.array_join(F.col(f"a.{c}"), ",").alias(c)
    return a.select("conv_id", "turn", join("cited"), join("invented"), join("unused"), F.length("a.clean").cast("long").alias("clean_chars"))


@query("sse_frames", "SELECT conv_id, sha256(string_agg(concat('event: ', role, chr(10), 'data: ', CAST(turn AS VARCHAR), chr(10), chr(10)), '' ORDER BY turn)) AS digest, count(*) AS parsed FROM conversations GROUP BY conv_id")
def sse_frames(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", answer.frame(F.col("role"), F.col("turn").cast("string")).alias("f"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "f"))), lambda x: x["f"]), "")
    return rows.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.sha2("body", 256).alias("digest"), F.size(answer.frames(F.col("body"))).cast("long").alias("parsed"))


@query(
    "answer_events",
    f"""WITH r AS (SELECT b.item_id AS qid, count(m.chunk_id) AS n FROM benchmark b LEFT JOIN ({MARKED_SQL}) m ON m.qid = b.item_id GROUP BY 1)
SELECT qid, unnest(CASE WHEN n = 0 THEN ['step', 'sources', 'delta', 'done'] ELSE ['step', 'step', 'sources', 'step', 'delta', 'done'] END) AS kind, unnest(range(CASE WHEN n = 0 THEN 4 ELSE 6 END)) AS seq,
  unnest(CASE WHEN n = 0 THEN ['searching', '0', '{REFUSAL}', 'refused'] ELSE ['searching', 'reading', CAST(n AS VARCHAR), 'writing', 'See [1].', 'answered'] END) AS payload FROM r""",
)
def answer_events(spark, d):
    r = retrieve.results(question_rows(spark, d), marked(spark, d))
    said = question_rows(spark, d).select("qid", F.lit("See [1][9].").alias("text"))
    return answer.event_rows(r, said).withColumn("seq", F.col("seq").cast("long"))
