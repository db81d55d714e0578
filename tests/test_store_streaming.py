import json

import pytest
from pyspark.sql import functions as F

from quire.operators import library
from quire.sources import files
from quire.sources.store import Store
from quire.streaming import ingest


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, status string, sha256 string")


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, doc_id string, text string")


def test_reindexing_leaves_no_stale_row(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put({"documents": docs(spark, ("a", "ready", "1"), ("b", "ready", "2")), "chunks": chunks(spark, ("a1", "a", "old"), ("b1", "b", "x")), "vectors": chunks(spark, ("a1", "a", ""), ("b1", "b", ""))})
    s.put({"chunks": chunks(spark, ("a2", "a", "new")), "vectors": chunks(spark, ("a2", "a", ""))})
    assert {r.chunk_id for r in s.read("chunks").collect()} == {r.chunk_id for r in s.read("vectors").collect()} == {"a2", "b1"}


def test_deletion_survives_a_crash(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put({"documents": docs(spark, ("a", "ready", "1"), ("b", "ready", "2")), "chunks": chunks(spark, ("a1", "a", "t"), ("b1", "b", "x"))})

    def fail():
        raise RuntimeError("power cut")

    with pytest.raises(RuntimeError):
        s.delete(docs(spark, ("a", "", "")), fail=fail)
    again = Store(spark, str(tmp_path))
    assert {r.doc_id for r in again.visible("chunks").collect()} == {"b"} and again.read("chunks").count() == 2
    again.purge()
    assert {r.doc_id for r in again.read("chunks").collect()} == {r.doc_id for r in again.read("documents").collect()} == {"b"}
    again.delete(docs(spark, ("unknown", "", "")))
    assert again.read("documents").count() == 1


def test_a_change_without_pointer_is_no_change(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.publish({"documents": docs(spark, ("a", "ready", "1"))})
    bad = chunks(spark, ("c", "d", "t")).withColumn("x", F.expr("raise_error('broken')"))
    with pytest.raises(Exception, match="broken"):
        s.publish({"documents": docs(spark, ("z", "ready", "9")), "chunks": bad})
    assert [r.doc_id for r in s.read("documents").collect()] == ["a"] and s.read("chunks") is None


def test_embedders_never_mix(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.guard("hashing:64") == "stamp" and s.guard("hashing:64") == "ok"
    s.publish({"vectors": chunks(spark, ("a1", "a", ""))})
    with pytest.raises(ValueError, match="hashing:64"):
        s.guard("other:64")
    assert s.guard("other:64", reset=True) == "rebuild" and s.read("vectors").count() == 0 and s.guard("other:64") == "ok"


def test_upsert_keeps_the_first_date(spark):
    old = spark.createDataFrame([("a", "t", 1, 1), ("b", "u", 1, 1)], "doc_id string, title string, created_at int, updated_at int")
    new = spark.createDataFrame([("a", "T"), ("c", "V")], "doc_id string, title string")
    rows = {r.doc_id: tuple(r)[1:] for r in library.upsert(old, new, F.lit(5)).collect()}
    assert rows == {"a": ("T", 1, 5), "b": ("u", 1, 1), "c": ("V", 5, 5)}


def test_cached_pages(spark):
    schema = "sha256 string, page int, strategy string, text string, error string, deferred boolean, extractor_version int"
    rec = [("s", 1, "ocr", "t", "", False, 3), ("s", 2, "ocr", "t", "", False, 2), ("s", 3, "ocr", "t", "boom", False, 3), ("s", 4, "ocr", "", "", False, 3), ("s", 5, "skip", "", "", False, 3), ("s", 6, "ocr", "t", "", True, 3)]
    todo = library.pages_to_do(spark.createDataFrame([("s", i) for i in range(1, 8)], "sha256 string, page int"), spark.createDataFrame(rec, schema), 3)
    assert {r.page for r in todo.collect()} == {2, 3, 4, 6, 7}


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.txt").write_text("no")
    pdf = files.pdf_files(spark, str(tmp_path)).collect()
    assert [(r.name, r.length) for r in pdf] == [("a.pdf", 10)]
    md = tmp_path / "md"
    md.mkdir()
    (md / "x.md").write_text("<!-- source: Real Name.pdf -->\n\ntext")
    (md / "y.md").write_text("text")
    assert {r.name for r in files.markdown_files(spark, str(md)).collect()} == {"Real Name.pdf", "y"}
    side = tmp_path / "side"
    side.mkdir()
    (side / "good.json").write_text(json.dumps({"document": "d", "sha256": "s", "records": [{"page": 2, "text": "B", "strategy": "ocr", "kind": "scanned"}, {"page": 1, "text": "", "strategy": "ocr", "kind": "digital"}, {"page": 3, "strategy": "skip"}]}))
    (side / "bad.json").write_text("{oops")
    got = files.sidecars(spark, str(side))
    assert sorted(r.page for r in got.collect()) == [1, 2, 3]
    text = files.markdown_of(got).first().markdown
    assert text.index("page 1 | digital") < text.index("> no text") < text.index("page 2 | scanned") and "page 3" not in text


BODY = "<!-- page 1 | digital | text -->\n# 1 Scope\n\nThese are enough words for one whole chunk of text.\n"


def run(spark, src, out, cp, **more):
    ingest.run_all(lambda: ingest.ingest(spark, str(src), out, cp, **more))


def ends(spark, out):
    return {(r.name, r.batch): r.state for r in ingest.jobs(spark, out).where("step = 4").collect()}


def test_ingest_stream(spark, tmp_path, monkeypatch):
    from quire.functions.vectors import hashing_embedder

    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "Policy 2023.md").write_text(BODY)
    (src / "copy.md").write_text(BODY)
    (src / "Empty 2020.md").write_text("<!-- page 1 | digital | text -->\n\n")
    embed = hashing_embedder(16)
    run(spark, src, out, cp, embed=embed)
    assert ends(spark, out) == {("Policy 2023", 0): "ready", ("copy", 0): "duplicate", ("Empty 2020", 0): "failed"}
    assert {r.state for r in ingest.jobs(spark, out).collect()} == set(ingest.STATES)

    # A known document with other words, a new one, and bytes that stand already; the batch breaks off before its end.
    (src / "Policy 2023 .md").write_text(BODY.replace("enough", "plenty of"))
    (src / "Other 2024.md").write_text(BODY.replace("These", "Those"))
    (src / "late copy.md").write_text(BODY)
    real = ingest.keyword.update
    with monkeypatch.context() as m:
        m.setattr(ingest.keyword, "update", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(spark, src, out, cp, embed=embed)
    assert ingest.keyword.update is real
    assert {r.doc_id for r in ingest.standing(spark, out, "chunks").collect()} == {"policy-2023"}
    run(spark, src, out, cp, embed=embed)
    assert {k[0]: v for k, v in ends(spark, out).items() if k[1] == 1} == {"Policy 2023 ": "ready", "Other 2024": "ready", "late copy": "duplicate"}
    made = {r.doc_id: (r.year, r.chunks, r.status) for r in ingest.standing(spark, out, "documents").collect()}
    assert made == {"policy-2023": (2023, 1, "ready"), "other-2024": (2024, 1, "ready"), "empty-2020": (2020, 0, "failed")}
    chunks = ingest.standing(spark, out, "chunks").collect()
    assert len(chunks) == 2 and sum("plenty of" in r.text for r in chunks) == 1
    assert {r.chunk_id for r in ingest.standing(spark, out, "vectors").collect()} == {r.chunk_id for r in chunks}
    at = ingest.keyword.open_index(spark, f"{out}/postings")
    asked = spark.createDataFrame([(1, "plenty"), (2, "enough"), (3, "Those")], "qid int, question string")
    found = {r.qid: r.chunk_id for r in ingest.keyword.bm25(at, asked).collect()}
    of = {r.chunk_id: r.doc_id for r in chunks}
    assert {q: of[c] for q, c in found.items()} == {1: "policy-2023", 2: "other-2024", 3: "other-2024"} and at.totals.first().chunks == 2


def test_changes_from_an_older_version_lose_nothing(spark, tmp_path):
    """While one writer deletes, another puts: both changes stand."""
    s, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    s.put({"documents": docs(spark, ("a", "ready", "1"), ("b", "ready", "2"))})
    s.delete(docs(spark, ("a", "", "")), ("documents",), fail=lambda: other.put({"documents": docs(spark, ("c", "ready", "3"))}))
    assert sorted(r.doc_id for r in s.read("documents").collect()) == ["b", "c"]
    calls = []

    def make(read):
        if not calls:
            other.put({"documents": docs(spark, ("d", "ready", "4"))})
        calls.append(1)
        return {"documents": read("documents").where("doc_id <> 'b'")}

    s.change(make)
    assert len(calls) == 2 and sorted(r.doc_id for r in s.read("documents").collect()) == ["c", "d"]
    assert len(list((tmp_path / "documents").iterdir())) == s._state()[0] == 6


def test_erasing_leaves_nothing_behind(spark, tmp_path):
    folder = tmp_path / "derived"
    folder.mkdir()
    for name in ("a.md", "a.pages.json", "ab.md", "b.md", "b.pdf", "notes.txt"):
        (folder / name).write_text("x")
    s = Store(spark, str(tmp_path / "store"))
    s.put({"documents": docs(spark, ("a", "ready", "1"), ("ab", "ready", "2"), ("b", "ready", "3")), "chunks": chunks(spark, ("a1", "a", "t"), ("b1", "b", "x"))})
    s.put({"chunks": chunks(spark, ("b2", "b", "y"))})

    def fail():
        raise RuntimeError("power cut")

    with pytest.raises(RuntimeError, match="power cut"):
        s.erase(docs(spark, ("a", "", "")), str(folder), fail=fail)
    assert s.read("chunks").where("doc_id = 'a'").count() == 1 and s.visible("chunks").where("doc_id = 'a'").count() == 0
    # Another deletion ends the one that broke off; a writer's folder that no version names yet stays.
    (tmp_path / "store" / "chunks" / "99-underway").mkdir()
    assert s.erase(docs(spark, ("b", "", "")), str(folder)) == ["b.md", "b.pdf"]
    assert sorted(p.name for p in folder.iterdir()) == ["ab.md", "notes.txt"]
    assert [r.doc_id for r in s.read("documents").collect()] == ["ab"] and s.read("chunks").count() == 0
    assert len(list((tmp_path / "store" / "pointers").glob("v*.json"))) == 1
    assert len(list((tmp_path / "store" / "documents").iterdir())) == 1 and {p.name for p in (tmp_path / "store" / "chunks").iterdir()} >= {"99-underway"}
    assert s.sweep() == [] and len(list((tmp_path / "store" / "chunks").iterdir())) == 2


def test_repair_at_every_cut():
    text, want = "A [1] b [9] c [12] d [1", "A [1] b  c  d [1"
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            carry, sent = "", ""
            for part in (text[:i], text[i:j], text[j:]):
                got, carry = ingest.repair(carry, part, 3)
                sent += got
                assert len(carry) <= 3
            assert sent + carry == want


def test_repair_stream(spark, tmp_path):
    src = tmp_path / "d"
    schema = "answer_id long, seq long, delta string, n_sources int, last boolean"
    parts = [[(1, 0, "See [", 2, False), (2, 0, "x [7", 2, False)], [(1, 1, "1] and [9", 2, False), (2, 1, "] y", 2, True)], [(1, 2, "] end [", 2, True)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
        query = ingest.repaired(spark.readStream.schema(schema).json(str(src))).writeStream.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.answer_id, r.seq))
    assert "".join(r.text for r in rows if r.answer_id == 1) == "See [1] and  end [" and "".join(r.text for r in rows if r.answer_id == 2) == "x  y"


def test_of_two_writers_one_publishes(spark, tmp_path):
    from quire.sources.store import Conflict

    s = Store(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    first = s.publish({"chunks": rows("a")})
    other = Store(spark, str(tmp_path))
    assert other.publish({"chunks": rows("b")}, since=first) == first + 1
    with pytest.raises(Conflict):
        s.publish({"chunks": rows("c")}, since=first)
    (tmp_path / "pointers" / f"v{first + 2}.json").write_text("")  # a writer died at its pointer
    assert [r.doc_id for r in s.read("chunks").collect()] == ["b"]
    s.put({"chunks": rows("d")})
    assert sorted(r.doc_id for r in s.read("chunks").collect()) == ["b", "d"]
