import pytest
from pyspark.sql import functions as F

from quire.operators import engines


def reader():
    def read(image):
        if image == "bad":
            raise RuntimeError("cannot read " + "x" * 500)
        return image.upper()

    return read


def broken():
    raise ImportError("no such engine")


PAGES = [("d", 1, "digital", "text-layer", "layer", "img"), ("d", 2, "scanned", "ocr", "old", "img"), ("d", 3, "hybrid", "both", "layer", "img"), ("d", 4, "empty", "skip", None, None), ("d", 5, "scanned", "ocr", None, "bad")]
SCHEMA = "document string, page int, kind string, strategy string, layer string, image string"


def test_extraction_by_strategy(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    rows = {r.page: r for r in engines.extracted(pages, reader, "up").collect()}
    assert [rows[i].text for i in range(1, 6)] == ["layer", "IMG", "layer\n\nIMG", "", ""]
    assert rows[5].error.startswith("RuntimeError: cannot read") and len(rows[5].error) == 400 and not any(r.deferred for r in rows.values())
    waiting = {r.page: r.deferred for r in engines.extracted(pages, None).collect()}
    assert waiting == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_engines_compared_never_stop(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "bad")], "page long, image string")
    rows = {(r.engine, r.page): (r.ok, r.text) for r in engines.compared(pages, {"up": reader, "none": broken}).collect()}
    assert rows == {("up", 1): (True, "A"), ("up", 2): (False, ""), ("none", 1): (False, ""), ("none", 2): (False, "")}


@pytest.mark.parametrize("text,table,clean,warning", [("```\nA\n```", False, "A", []), ("![x](y)", False, "", ["returned only"]), ("", False, "", ["empty output"]), ("a", True, "a", ["the page holds"]), ("the same line again\n" * 20, False, None, ["repetition loop"])])
def test_recognised(spark, text, table, clean, warning):
    r = spark.createDataFrame([(text,)], "t string").select(engines.recognised(F.col("t"), F.lit(table), F.lit(0)).alias("r")).first().r
    assert (clean is None or r.text == clean) and len(r.warnings) == len(warning) and all(a.startswith(b) for a, b in zip(r.warnings, warning))


def test_retry():
    seen = iter(["", "second"])
    assert engines.retried(lambda _: next(seen))("img") == "second"


def test_stream_of_lines(spark):
    lines = [(1, 2, '{"response":"b"}'), (1, 1, '{"response":"a"}'), (1, 3, '{"response":"","done":true}'), (1, 4, '{"response":"late"}'), (2, 1, '{"error":"gone"}')]
    got = {r.answer_id: (r.text, r.error) for r in engines.streamed(spark.createDataFrame(lines, "answer_id long, seq long, line string")).collect()}
    assert got == {1: ("ab", None), 2: ("", "gone")}


def test_extractive_answers_cite(spark):
    text = spark.range(1).select(engines.extractive(F.lit("gift limit"), F.array(F.lit("The limit is ten."), F.lit("Other."))).alias("a")).first().a
    assert text == "The limit is ten. [1]"


@pytest.mark.parametrize("url,ok", [("http://localhost:11434", True), ("http://127.0.0.1", True), ("http://10.1.2.3/x", True), ("http://box.local", True), ("http://server:80", True), ("https://example.com", False), ("http://8.8.8.8", False), ("", False)])
def test_only_local_hosts(url, ok):
    if ok:
        assert engines.require_local(url) == url
    else:
        with pytest.raises(ValueError):
            engines.require_local(url)


def test_providers():
    states = engines.provider_states()
    assert states["embedder", "hashing"] == "ready" and set(states.values()) <= {"ready", "missing-deps"}
    assert set(engines.provider_states("llm")) == {("llm", "extractive"), ("llm", "http")}
