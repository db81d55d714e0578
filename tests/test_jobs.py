"""The two jobs over growing copies: nothing twice, nothing lost, the same again on a rerun."""

import logging
import os
import re

import pytest

from jobs import clean_export, intake

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "This is a sentence that reads like any other one, it has words and it ends here. "
NOISE = "xkcd" * 30


def put(spark, path, rows, name):
    """One more file below path, as a system that hands in documents writes it."""
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).coalesce(1).write.parquet(f"{path}-{name}")
    os.makedirs(path, exist_ok=True)
    (part,) = (f for f in os.listdir(f"{path}-{name}") if f.startswith("part-"))
    os.rename(f"{path}-{name}/{part}", f"{path}/{name}.parquet")


def places(tmp_path):
    return [str(tmp_path / n) for n in ("documents", "register", "checkpoint")]


def standing(spark, register):
    return {r.doc_id: (r.state, r.duplicate_of) for r in intake.current(spark, register).collect()}


def test_intake_takes_only_what_is_new(spark, tmp_path, caplog):
    documents, register, checkpoint = places(tmp_path)
    put(spark, documents, [(3, GOOD, "a"), (1, GOOD, "b"), (2, GOOD * 2, None), (4, "  \n ", "a"), (5, None, ""), (6, NOISE, "a"), (None, GOOD * 2, "a"), (None, GOOD * 2, "a"), (7, GOOD * 3, "a"), (7, GOOD * 3, "a")], "one")
    with caplog.at_level(logging.INFO, "jobs.intake"):
        assert intake.run(spark, documents, register, checkpoint) == {"ready": 3, "duplicate": 1, "failed": 3, "unreadable": 1}
    assert "read 10 rows" in caplog.text and "batch 0" in caplog.text
    first = {1: ("ready", None), 2: ("ready", None), 3: ("duplicate", 1), 4: ("failed", None), 5: ("failed", None), 6: ("unreadable", None), 7: ("ready", None), None: ("failed", None)}
    assert standing(spark, register) == first
    assert intake.run(spark, documents, register, checkpoint) == {} and standing(spark, register) == first

    # 0 has a lower id than 1, which came first; 1 becomes another text, so 3 is judged again; 8 copies what 1 says now.
    put(spark, documents, [(0, GOOD * 2, "a"), (8, GOOD * 5, "c"), (1, GOOD * 5, "b"), (4, GOOD * 6, "a")], "two")
    assert intake.run(spark, documents, register, checkpoint) == {"ready": 3, "duplicate": 2}
    now = first | {0: ("duplicate", 2), 1: ("ready", None), 3: ("ready", None), 4: ("ready", None), 8: ("duplicate", 1)}
    assert standing(spark, register) == now
    rows = intake.read_register(spark, register).collect()
    assert len(rows) == 13 and {r.batch for r in rows} == {0, 1} and intake.current(spark, register).count() == 10
    assert {r.source for r in rows if r.doc_id in (2, 5)} == {None, ""}


def test_intake_runs_a_broken_batch_again(spark, tmp_path, monkeypatch):
    documents, register, checkpoint = places(tmp_path)
    put(spark, documents, [(i, GOOD * (1 + i % 3), "a") for i in range(9)], "one")
    intake.run(spark, documents, register, checkpoint)
    put(spark, documents, [(i, GOOD * (1 + i % 5), "a") for i in range(6, 20)], "two")
    real = intake.read_register

    def broken(session, path):
        if os.path.exists(f"{path}/batch=1"):  # the second batch's rows are written, but not yet committed
            raise RuntimeError("lost")
        return real(session, path)

    monkeypatch.setattr(intake, "read_register", broken)
    with pytest.raises(Exception, match="lost"):
        intake.run(spark, documents, register, checkpoint)
    half = real(spark, register).count()
    monkeypatch.setattr(intake, "read_register", real)
    intake.run(spark, documents, register, checkpoint)
    rows = real(spark, register).collect()
    assert len(rows) == half == 23 and len({(r.batch, r.doc_id) for r in rows}) == 23
    assert standing(spark, register) == {i: ("ready", None) if i in (0, 1, 2) else ("duplicate", i % 3) for i in range(6)} | {
        i: ("duplicate", i % 5) if i % 5 < 3 else ("ready", None) if i in (8, 9) else ("duplicate", 8 if i % 5 == 3 else 9) for i in range(6, 20)
    }


def test_intake_in_small_batches(spark, tmp_path):
    documents, register, checkpoint = places(tmp_path)
    for k in range(3):
        put(spark, documents, [(10 * k + i, GOOD * (1 + i), "a") for i in range(4)], f"f{k}")
    assert intake.run(spark, documents, register, checkpoint, {"max_files_per_batch": 1}) == {"ready": 4, "duplicate": 8}
    assert {r.batch for r in intake.read_register(spark, register).select("batch").distinct().collect()} == {0, 1, 2}


def test_intake_of_an_empty_table(spark, tmp_path):
    documents, register, checkpoint = places(tmp_path)
    put(spark, documents, [], "none")
    assert intake.run(spark, documents, register, checkpoint) == {}
    put(spark, documents, [(1, GOOD, "a")], "one")
    assert intake.run(spark, documents, register, checkpoint) == {"ready": 1}


def corpus():
    """Two sources with a footer each, one too small to have any."""
    rows = [(i, f"Bank of Examples\n# Text {i}\n{GOOD}\nPage {i} of 90\n| Page {i} of 90 |", "a") for i in range(8)]
    rows += [(100 + i, f"Text {i}\r\n{GOOD}\n** Confidential **" if i % 2 else f"only text {i}", "b") for i in range(10)]
    rows += [(200 + i, f"Bank of Examples\nx{i}", "c") for i in range(3)]
    return [*rows, (300, None, "a"), (301, "Bank of Examples\nnone", None), (302, "Confidential", "a"), (303, ("loops and loops again\n" * 20).strip(), "b")]


def plain(rows, share):
    bare = lambda x: x.strip().strip("#* ").strip()
    cut = lambda t: re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", t or "")
    key = lambda x: re.sub(r"\d+", "#", bare(x)).strip(" *")
    gone = set()
    for source in {s for _, _, s in rows if s}:
        docs = [t for _, t, s in rows if s == source]
        if len(docs) < 4:
            continue
        seen = [{key(x) for x in cut(t) if x.strip() and not x.strip().startswith("|") and len(x.strip()) <= 90 and bare(x)} for t in docs]
        for k in set().union(*seen):
            n = sum(k in s for s in seen)
            if n >= max(3, int(len(docs) * share)) and (re.search("[A-Za-z]", k) or n >= max(3.0, len(docs) * 0.6)):
                gone |= {(source, bare(x)) for t in docs for x in cut(t) if key(x) == k and not x.strip().startswith("|")}
    return {(i, s): "\n".join(x for x in cut(t) if (s, bare(x)) not in gone) for i, t, s in rows}


def texts(spark, out):
    return {(r.doc_id, r.source): r.text for r in clean_export.read_documents(spark, out).collect()}


def test_clean_export(spark, tmp_path, caplog):
    documents, out = str(tmp_path / "documents"), str(tmp_path / "out")
    put(spark, documents, corpus(), "one")
    cfg = {"furniture_share": 0.4}
    want = plain(corpus(), 0.4)
    with caplog.at_level(logging.INFO, "jobs.clean_export"):
        said = clean_export.run(spark, documents, out, cfg)
    assert texts(spark, out) == want and "\nPage 3 of 90" not in want[3, "a"] and "Bank" in want[200, "c"]
    rows = {r.doc_id: r for r in clean_export.read_documents(spark, out).collect()}
    assert said["documents"] == len(rows) == 25 and said["lines_removed"] == sum(r.n_removed for r in rows.values()) > 20 and "repeated lines" in caplog.text
    assert rows[303].loops == 20 and rows[3].n_lines == 5 and rows[300].text == "" and rows[300].tokens == 0
    again = clean_export.run(spark, documents, out, cfg | {"broadcast_rows": 0})
    assert again == said and texts(spark, out) == want


def test_clean_export_of_some_sources_leaves_the_others(spark, tmp_path):
    documents, out = str(tmp_path / "documents"), str(tmp_path / "out")
    rows = corpus()
    put(spark, documents, rows, "one")
    clean_export.run(spark, documents, out, {"furniture_share": 0.4})
    more = [(150 + i, f"fresh {'abcdefghijklmnopqrst'[i]}\nA new footer\nConfidential", "b") for i in range(20)]
    put(spark, documents, more + [(9, "Bank of Examples\nlate", "a")], "two")
    clean_export.run(spark, documents, out, {"furniture_share": 0.4, "sources": ["b"]})
    before, after = plain(rows, 0.4), plain(rows + more, 0.4)
    assert texts(spark, out) == {k: (after if k[1] == "b" else before)[k] for k in after if k[1] == "b" or k in before}
    assert {r.bare for r in spark.read.parquet(f"{out}/furniture").where("source = 'b'").collect()} == {"A new footer", "Confidential"}


def test_command_lines_read_the_config(tmp_path):
    (tmp_path / "c.json").write_text('{"garble": 0.9}')
    assert intake.settings(tmp_path / "c.json") == intake.settings() | {"garble": 0.9}
    assert clean_export.settings()["furniture_share"] == 0.02
