"""Queries that SQL does not check, recomputed row by row in plain Python on the smallest tables."""

import difflib
import hashlib
import math
import re
import sqlite3

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{D}/{n}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def plain_vector(text, dim):
    out = [0] * dim
    line = " ".join(text.lower().split())
    for i in range(max(1, len(line) - 2)) if line else ():
        h = hashlib.blake2b(line[i : i + 3].encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] % 2 else -1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_hash_embed(spark, texts):
    rows = entry.queries()["hash_embed"](spark, D).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == "hashing:256" and max(abs(a - b) for a, b in zip(r.embedding, plain_vector(texts[r.doc_id], 256), strict=True)) < 1e-6


def test_prior_agreement(spark, duck):
    words = lambda t: re.findall("[a-z0-9]+", "".join(c if c.isascii() else " " for c in t.lower()))
    of = {}
    for i, source, text in duck.sql("SELECT doc_id, source, text FROM documents ORDER BY doc_id").fetchall():
        of.setdefault(source, []).append((i, words(text)))
    want = {}
    for rows in of.values():
        for k, (i, a) in enumerate(rows):
            b = rows[k + 1][1] if k + 1 < len(rows) else []
            want[i] = round(difflib.SequenceMatcher(None, a, b).ratio(), 6) if len(a) >= 60 and b else None
    assert {r.doc_id: r.agreement for r in entry.queries()["prior_agreement"](spark, D).collect()} == want


def test_bench_picks(spark, duck):
    from quire.operators import pages
    from quire.plans import catalogue

    scored = [r.asDict() for r in pages.bench_scores(catalogue.routed(spark, D)).collect()]
    used, want = set(), []
    for kind in ("poor_scan", "mixed", "full_scan", "dense_table", "clean_digital"):
        ranked = sorted((r for r in scored if r[kind] > 0), key=lambda r: (-r[kind], r["doc"], r["page"]))
        pick = next((r for r in ranked if r["doc"] not in used), ranked[0] if ranked else None)
        if pick:
            used.add(pick["doc"])
            want.append((kind, pick["doc"], pick["page"], round(pick[kind], 3)))
    assert [tuple(r) for r in entry.queries()["bench_picks"](spark, D).collect()] == want


def test_bm25_stemmed(spark, texts, duck):
    """Every hit of every question beside SQLite's FTS5 over the same three weighted fields."""
    from quire.functions.stem import stem
    from quire.operators.keyword import MARKED, PLAIN
    from quire.plans import text_catalogue

    chunks = text_catalogue.fielded(spark, D).collect()
    questions = {r.qid: r.question for r in text_catalogue.stemmed_questions(spark, D).collect()}
    fold = str.maketrans(MARKED, PLAIN)
    tokens = lambda t: [stem(w) for w in re.findall(r"[^\W_]+", t.lower().translate(fold))]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text, section, identifiers, tokenize = 'unicode61')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [(c.chunk_id, *(" ".join(tokens(x)) for x in (c.text, c.section, c.identifiers))) for c in chunks])
    got = {}
    for r in entry.queries()["bm25_stemmed"](spark, D).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    for qid, question in questions.items():
        parts = [tokens(w) for w in question.replace('"', "").split()]
        match = " OR ".join('"' + " ".join(p) + '"' for p in parts if p)
        rows = db.execute("SELECT id, -bm25(f, 0, 1.0, 0.5, 0.25) FROM f WHERE f MATCH ?", (match,)).fetchall()
        want = sorted(((-round(s, 7), i) for i, s in rows))[:30]
        have = sorted(got.get(qid, []))
        assert len(have) == len(want), qid
        for (_, _, a), (b, _) in zip(have, want):
            assert math.isclose(a, -b, rel_tol=1e-5, abs_tol=1e-6), (qid, a, b)


def test_hybrid_search(spark, texts, duck):
    """Dense and keyword lists, fusion, overlap, threshold and editions, for every question."""
    from quire.plans.text_catalogue import BM25_SQL

    questions = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    keyword = {}
    for q, c, _, rank in duck.sql(f"SELECT qid, chunk_id, score, rank FROM ({BM25_SQL})").fetchall():
        keyword.setdefault(q, {})[c] = rank
    vectors = {i: plain_vector(t, 256) for i, t in texts.items()}
    words = lambda t: {w for w in t.lower().split()}
    got = {r.qid: r for r in entry.queries()["hybrid_search"](spark, D).collect()}
    assert set(got) == set(questions)
    for q, text in questions.items():
        asked = plain_vector(text, 256)
        near = sorted(((-round(sum(a * b for a, b in zip(asked, v)), 6), i) for i, v in vectors.items()))
        dense = {i: k + 1 for k, (_, i) in enumerate(near[:30])}
        if len({s for s, _ in near[:31]}) < 31:  # ties to single precision: the lists may differ in them
            ties = {i for s, i in near if sum(s == x for x, _ in near[:31]) > 1}
        else:
            ties = set()
        fused = sorted(((-(1 / (60 + dense[i]) if i in dense else 0) - (1 / (60 + keyword[q][i]) if i in keyword.get(q, {}) else 0), dense.get(i, 10**6), i) for i in {*dense, *keyword.get(q, {})}))[:30]
        rows = []
        for rank, (_, _, i) in enumerate(fused):
            score = len(words(text) & words(texts[i])) / max(1, len(words(text)))
            if score >= 0.5:
                rows.append((-score, rank, i))
        rows = sorted(rows)[:8]
        newest = {}
        for _, _, i in rows:
            newest[source[i]] = max(newest.get(source[i], 0), 2023 + i % 3)
        old = lambda i: source[i] != "" and 2023 + i % 3 < newest[source[i]]  # noqa: B023, E731
        want = [i for *_, i in sorted((old(i), s, r, i) for s, r, i in rows)]
        if not ties & set(want):
            assert list(got[q].passages) == want, q
            assert got[q].refused == (not want) and got[q].document_count == len(want)
            assert list(got[q].vintage_conflicts) == sorted({source[i] for i in want if old(i)})


def test_prior_findings(spark, duck):
    words = lambda t: re.findall("[a-z0-9]+", "".join(c if c.isascii() else " " for c in t.lower()))
    from quire.plans import catalogue

    want = set()
    for r in catalogue.records(spark, D).where("strategy <> 'skip'").collect():
        prior = r.text if r.page % 3 == 0 else " ".join(reversed(r.text.split(" ")))
        a, b = words(prior), words(r.text)
        share = difflib.SequenceMatcher(None, a, b).ratio() if len(a) >= 60 and b else 1
        if share < 0.55:
            want.add((r.document, r.page, "warning", "disagrees-with-prior-ocr"))
    got = entry.queries()["prior_findings"](spark, D).collect()
    assert want and {(r.document, r.page, r.severity, r.check) for r in got} == want and len(got) == len(want)


def test_uuid5_is_that_of_the_standard(spark):
    import uuid

    from pyspark.sql import functions as F

    from quire.functions.identity import nfkc, uuid5

    names = ["", "a", "doc:12", "Zürich ﬁ", "x" * 500]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("id"), nfkc()("n").alias("k")).collect()
    assert [r.id for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names] and rows[3].k == "Zürich fi"


def test_sidecars_and_removal_of_files(spark, tmp_path):
    from quire.sources import files

    where, schema = str(tmp_path / "side"), "document string, page int, text string, extracted_at string"
    files.write_sidecars(spark.createDataFrame([("d", 1, "old", "1"), ("e", 1, "x", "1")], schema), where)
    files.write_sidecars(spark.createDataFrame([("d", 1, "new", "2"), ("d", 2, "more", "2")], schema), where)
    assert {(r.document, r.page, r.text) for r in files.latest_sidecars(spark, where, schema).collect()} == {("d", 1, "new"), ("d", 2, "more"), ("e", 1, "x")}
    for n in ("a.md", "b.json"):
        (tmp_path / n).write_text("x")
    assert files.remove_files(spark, str(tmp_path), ["a.md", "none.md", "side"]) == ["a.md"] and (tmp_path / "b.json").exists() and (tmp_path / "side").exists()
    with pytest.raises(ValueError):
        files.remove_files(spark, str(tmp_path), ["../b.json"])
