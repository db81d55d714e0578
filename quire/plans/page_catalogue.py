"""More registered queries: tables of pages from what they draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import pages, tables
from quire.plans.catalogue import query, t

KEYS = ["doc", "page"]


def drawings(spark, d):
    """Stand-ins for the drawings of a page, one per document: a grid (some rules in two pieces, some cells merged), two boxes
    that touch or stand apart, and a text block for each line of the text."""
    docs = t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    g = docs.where("page % 10 <> 9").selectExpr("doc", "page", "1 + page % 5 AS r", "1 + page % 4 AS c", "50D + page % 7 AS x", "60D + page % 11 AS y")
    level = g.selectExpr("*", "explode(sequence(0, r)) AS i").selectExpr("*", "y + 40 * i + 0.4D * ((page * 13 + i) % 5) AS at", "x + 90 * c AS right")
    level = level.selectExpr("doc", "page", "explode(CASE WHEN page % 6 = 1 THEN array(struct(x AS a, x + 45 AS b), struct(x + 47 AS a, right AS b)) ELSE array(struct(x AS a, right AS b)) END) AS e", "at")
    level = level.selectExpr("doc", "page", "e.a AS x0", "at AS y0", "e.b AS x1", "at AS y1")
    upright = g.selectExpr("*", "explode(sequence(0, c)) AS j").selectExpr("doc", "page", "x + 90 * j AS x0", "y AS y0", "x + 90 * j AS x1", "CASE WHEN page % 8 = 2 AND j = 1 THEN y + 40 ELSE y + 40 * r END AS y1")
    box = g.where("page % 3 = 0").selectExpr("doc", "page", "explode(array(0, 50 + 10 * (page % 2))) AS left", "x", "y + 40 * r + 60 AS top")
    boxes = box.selectExpr("doc", "page", "x + left AS x0", "top AS y0", "x + left + 50 AS x1", "top + 35 AS y1")
    blocks = docs.select("doc", "page", F.explode(F.split("text", "\n")).alias("line")).selectExpr("doc", "page", "36D + 6 * (length(line) % 8) AS x0")
    return docs.select(*KEYS), level.unionByName(upright), boxes, blocks


DRAWN_SQL = """g AS (SELECT source AS doc, doc_id AS page, 1 + doc_id % 5 AS r, 1 + doc_id % 4 AS c, CAST(50 + doc_id % 7 AS DOUBLE) AS x, CAST(60 + doc_id % 11 AS DOUBLE) AS y FROM documents WHERE doc_id % 10 <> 9),
hl AS (SELECT doc, page, y + 40 * i + CAST(0.4 AS DOUBLE) * ((page * 13 + i) % 5) AS at_, x, x + 90 * c AS right_ FROM (SELECT *, unnest(range(r + 1)) AS i FROM g)),
h AS (SELECT doc, page, at_, x AS lo, CASE WHEN page % 6 = 1 THEN x + 45 ELSE right_ END AS hi FROM hl UNION ALL SELECT doc, page, at_, x + 47, right_ FROM hl WHERE page % 6 = 1),
v AS (SELECT doc, page, x + 90 * j AS at_, y AS lo, CASE WHEN page % 8 = 2 AND j = 1 THEN y + 40 ELSE y + 40 * r END AS hi FROM (SELECT *, unnest(range(c + 1)) AS j FROM g)),
bx AS (SELECT doc, page, x + l AS x0, y + 40 * r + 60 AS y0, x + l + 50 AS x1, y + 40 * r + 95 AS y1 FROM (SELECT *, unnest([0, 50 + 10 * (page % 2)]) AS l FROM g WHERE page % 3 = 0)),
hr AS (SELECT * FROM h UNION ALL SELECT doc, page, y0, x0, x1 FROM bx UNION ALL SELECT doc, page, y1, x0, x1 FROM bx),
vr AS (SELECT * FROM v UNION ALL SELECT doc, page, x0, y0, y1 FROM bx UNION ALL SELECT doc, page, x1, y0, y1 FROM bx)"""


def _edges_sql(name: str, rows: str) -> str:
    return f"""{name}1 AS (SELECT *, at_ - lag(at_) OVER (PARTITION BY doc, page ORDER BY at_) > 3 AS far FROM {rows}),
{name}2 AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY doc, page ORDER BY at_) AS p FROM {name}1),
{name}3 AS (SELECT *, max(hi) OVER (PARTITION BY doc, page, p ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {name}2),
{name}4 AS (SELECT *, count(*) FILTER (lo > b + 3) OVER (PARTITION BY doc, page, p ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS s FROM {name}3),
{name} AS MATERIALIZED (SELECT doc, page, p * 1000 + s AS e, min(at_) AS at_, min(lo) AS lo, max(hi) AS hi FROM {name}4 GROUP BY ALL)"""


CELLS_SQL = f"""{DRAWN_SQL},
{_edges_sql("he", "hr")},
{_edges_sql("ve", "vr")},
pt AS MATERIALIZED (SELECT he.doc, he.page, he.e AS h, ve.e AS v, ve.at_ AS x, he.at_ AS y, he.hi > ve.at_ + 3 AS onward, ve.hi > he.at_ + 3 AS down FROM he JOIN ve ON he.doc = ve.doc AND he.page = ve.page AND ve.at_ BETWEEN he.lo - 3 AND he.hi + 3 AND he.at_ BETWEEN ve.lo - 3 AND ve.hi + 3),
rt AS (SELECT a.doc, a.page, a.h, a.v, min(b.v) AS v2 FROM pt a JOIN pt b ON a.doc = b.doc AND a.page = b.page AND a.h = b.h AND b.v > a.v AND b.down GROUP BY ALL),
bl AS (SELECT a.doc, a.page, a.h, a.v, min(b.h) AS h2 FROM pt a JOIN pt b ON a.doc = b.doc AND a.page = b.page AND a.v = b.v AND b.h > a.h AND b.onward GROUP BY ALL),
cell AS MATERIALIZED (SELECT rt.*, bl.h2, row_number() OVER (PARTITION BY rt.doc, rt.page ORDER BY rt.h, rt.v) AS n FROM rt JOIN bl USING (doc, page, h, v) WHERE EXISTS (SELECT 1 FROM pt c WHERE c.doc = rt.doc AND c.page = rt.page AND c.h = bl.h2 AND c.v = rt.v2)),
corner AS MATERIALIZED (SELECT doc, page, n, unnest([h * 1000000 + v, h * 1000000 + v2, h2 * 1000000 + v, h2 * 1000000 + v2]) AS k FROM cell),
reach AS (SELECT doc, page, n AS a, n AS b FROM cell UNION SELECT r.doc, r.page, r.a, y.n FROM reach r JOIN corner x ON x.doc = r.doc AND x.page = r.page AND x.n = r.b JOIN corner y ON y.doc = r.doc AND y.page = r.page AND y.k = x.k),
part AS MATERIALIZED (SELECT doc, page, a AS n, min(b) AS tab FROM reach GROUP BY ALL)"""


@query(
    "table_geometry",
    f"""WITH RECURSIVE {CELLS_SQL},
s AS (SELECT doc, page, tab, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2),
tc AS (SELECT doc, page, count(*) AS table_count, sum(n) AS table_cells FROM s GROUP BY ALL),
ru AS (SELECT doc, page, count(*) AS n FROM (SELECT doc, page FROM h WHERE hi - lo > 30 UNION ALL SELECT doc, page FROM v WHERE hi - lo > 30 UNION ALL SELECT doc, page FROM bx, range(4)) GROUP BY ALL),
co AS (SELECT doc, page, count(*) AS n FROM (SELECT source AS doc, doc_id AS page, length(line) % 8 AS b FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)
SELECT d.source AS doc, d.doc_id AS page, coalesce(table_count, 0) AS table_count, CAST(coalesce(table_cells, 0) AS BIGINT) AS table_cells, round(0.6 * least(1.0, ln(1 + coalesce(ru.n, 0)) / ln(60)) + 0.4 * least(1.0, coalesce(co.n, 0) / 5.0), 3) AS likeness
FROM documents d LEFT JOIN tc ON tc.doc = d.source AND tc.page = d.doc_id LEFT JOIN ru ON ru.doc = d.source AND ru.page = d.doc_id LEFT JOIN co ON co.doc = d.source AND co.page = d.doc_id""",
)
def table_geometry(spark, d):
    return tables.page_tables(*drawings(spark, d), KEYS)


@query(
    "table_boxes",
    f"""WITH RECURSIVE {CELLS_SQL},
b AS (SELECT c.doc, c.page, p.tab, min(x.at_) AS x0, min(y.at_) AS y0, max(x2.at_) AS x1, max(y2.at_) AS y1, count(*) AS n_cells, count(DISTINCT c.h) AS n_rows, count(DISTINCT c.v) AS n_columns
FROM cell c JOIN part p USING (doc, page, n) JOIN ve x ON x.doc = c.doc AND x.page = c.page AND x.e = c.v JOIN ve x2 ON x2.doc = c.doc AND x2.page = c.page AND x2.e = c.v2
JOIN he y ON y.doc = c.doc AND y.page = c.page AND y.e = c.h JOIN he y2 ON y2.doc = c.doc AND y2.page = c.page AND y2.e = c.h2 GROUP BY ALL HAVING count(*) >= 2)
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0) AS INT) AS nth, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1, n_cells, n_rows, n_columns FROM b""",
)
def table_boxes(spark, d):
    _, lines, boxes, _ = drawings(spark, d)
    found = tables.tables(lines, boxes, KEYS)
    return found.select(*KEYS, "nth", *(F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")), "n_cells", "n_rows", "n_columns")


@query(
    "routed_by_tables",
    f"""WITH RECURSIVE {CELLS_SQL},
tc AS (SELECT doc, page, count(*) AS n FROM (SELECT doc, page, tab FROM part GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
p AS (SELECT d.source AS doc, d.doc_id AS page, length(text) / 96.7 AS density, doc_id % 4 = 1 AS full_page, coalesce(tc.n, 0) AS n FROM documents d LEFT JOIN tc ON tc.doc = d.source AND tc.page = d.doc_id),
k AS (SELECT *, CASE WHEN density < 3.0 AND NOT full_page THEN '1' WHEN full_page AND density >= 3.0 THEN '2a' WHEN full_page THEN '2b' WHEN density < 12.0 THEN '5' WHEN n > 0 THEN '7' ELSE '8' END AS rule FROM p)
SELECT doc, page, rule, CASE rule WHEN '1' THEN 'no text and no picture' WHEN '2a' THEN 'a scan with a text layer that is trusted' WHEN '2b' THEN 'one picture covers the page' WHEN '5' THEN 'little text' WHEN '7' THEN concat('holds ', n, CASE WHEN n = 1 THEN ' table' ELSE ' tables' END) ELSE 'dense text' END AS reason,
CASE rule WHEN '1' THEN 'skip' WHEN '2a' THEN 'text-layer' WHEN '8' THEN 'text-layer' ELSE 'ocr' END AS strategy, rule = '2a' AS has_prior_text FROM k""",
)
def routed_by_tables(spark, d):
    """Routing by the tables that are found, with old scans' text layers trusted (rule 2a); the reason in words."""
    from quire.config import Routing

    told, lines, boxes, _ = drawings(spark, d)
    counted = tables.tables(lines, boxes, KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"))
    facts = t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), (F.length("text") / 96.7).alias("density"), (F.col("doc_id") % 4 == 1).alias("full"))
    both = facts.join(counted, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    raster = F.when(F.col("full"), F.lit(1.0)).otherwise(0.0)
    r = pages.route(F.col("density"), raster, F.lit(0.0), F.col("full"), F.col("n"), Routing(trust_prior_ocr=True))
    return both.select(*KEYS, r.alias("r")).select(*KEYS, "r.rule", "r.reason", "r.strategy", "r.has_prior_text")
