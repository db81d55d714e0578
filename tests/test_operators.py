import hashlib
import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.config import REFUSAL, Chunking, Retrieval, Routing
from quire.operators import answer, audit, chunking, keyword, library, pages, retrieve, structure

ROUTES = [
    # density, raster, garble, full page, tables -> rule
    (2.9, 0.19, 0.9, False, 0, "1"), (3.0, 0.0, 0.0, False, 0, "5"), (20.0, 0.9, 0.0, True, 0, "2b"), (1.0, 0.9, 0.0, True, 0, "2b"), (20.0, 0.0, 0.45, False, 0, "3"), (11.9, 0.20, 0.44, False, 0, "4"),
    (2.0, 0.20, 0.0, False, 0, "4"), (12.0, 0.19, 0.0, False, 0, "8"), (12.0, 0.20, 0.0, False, 1, "6"), (12.0, 0.1, 0.0, False, 1, "7"), (30.0, 0.0, 0.0, False, 0, "8"),
]


def test_routing_rules_and_edges(spark):
    df = spark.createDataFrame(ROUTES, "d double, r double, g double, f boolean, t int, want string")
    rows = df.select("want", pages.route(F.col("d"), F.col("r"), F.col("g"), F.col("f"), F.col("t")).alias("v")).collect()
    assert [r.v.rule for r in rows] == [r.want for r in rows]
    trusted = df.where("want = '2b'").select(pages.route(F.col("d"), F.col("r"), F.col("g"), F.col("f"), F.col("t"), Routing(trust_prior_ocr=True)).alias("v")).collect()
    assert {r.v.rule for r in trusted} == {"2a", "2b"}


def test_grid_coverage_counts_cells_once(spark):
    rng = random.Random(4)
    rects = [(p, 480.0, 480.0, x := rng.uniform(-50, 470), y := rng.uniform(-50, 470), x + rng.uniform(0, 300), y + rng.uniform(0, 300)) for p in range(6) for _ in range(5)] + [(9, 480.0, 480.0, 500.0, 0.0, 600.0, 10.0)]
    got = {r.page: r.coverage for r in pages.grid_coverage(spark.createDataFrame(rects, "page int, width double, height double, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()}
    for p in got:
        cells = set()
        for _, w, h, x0, y0, x1, y1 in (r for r in rects if r[0] == p):
            x0, y0, x1, y1 = max(0, x0), max(0, y0), min(w, x1), min(h, y1)
            if x0 < x1 and y0 < y1:
                cells |= {(c, r) for c in range(int(x0 / 10), min(47, int((x1 - 1e-6) / 10)) + 1) for r in range(int(y0 / 10), min(47, int((y1 - 1e-6) / 10)) + 1)}
        assert abs(got[p] - len(cells) / 2304) < 1e-12


MARKDOWN = "".join(
    f"<!-- page {n} | digital | text layer -->\nBANK MANUAL\n\n"
    + ("TABLE OF CONTENTS\n1.1 Risk Categories 3\n1.2 Limits ..... 4\n" if n == 1 else f"1.{n - 1} {'Risk Categories There are four kinds of risk here.' if n == 2 else f'Section {chr(64 + n)}'}\n\nThis is the body of part {chr(64 + n)}, long enough to be kept as text.\n- item {chr(64 + n)}\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    + f"Page {n} of 6\n"
    for n in range(1, 7)
)


def test_parse_structure(spark):
    docs = spark.createDataFrame([("m", MARKDOWN), ("empty", ""), ("null", None), ("unpaged", "# Title\ntext")], "doc string, markdown string")
    rows = structure.blocks_of(docs).orderBy("pos").collect()
    assert {r.doc for r in rows} == {"m"} and [r.pos for r in rows] == list(range(len(rows)))
    text = " ".join(r.text for r in rows)
    assert "BANK MANUAL" not in text and "of 6" not in text and "CONTENTS" not in text
    first = next(r for r in rows if r.kind == "heading")
    assert (first.number, first.title, first.page, first.level) == ("1.1", "Risk Categories", 2, 2)
    assert rows[first.pos + 1].text.startswith("There are four kinds")
    assert sum(r.kind == "table" for r in rows) == 5 and sum(r.kind == "list" for r in rows) == 5


def test_headings_of_a_contents_list_go(spark):
    """A bare heading goes if its page lists contents, it ends in a page number, another follows, or an entry went before."""
    page = lambda n, body: f"<!-- page {n} | digital | x -->\n{body}\n"
    body = "A body that is surely longer than forty characters in all."
    text = page(1, f"1 One ... 3\n2 Two\n{body}") + page(2, f"# Kept\n{body}\n# Bare\nshort") + page(3, "# First\n# Second\nshort\n# Third\nshort") + page(2, "# Late\nshort")
    got = structure.blocks_of(spark.createDataFrame([("d", text)], "doc string, markdown string")).where("kind = 'heading'").orderBy("pos").collect()
    assert [r.title for r in got] == ["Two", "Kept", "Bare", "Late"]


def test_documents_are_dealt_by_their_bytes(spark, monkeypatch):
    """Twice the text makes twice the tasks, whatever the number of shuffle partitions, and the blocks stay the same."""
    told = {}
    for n in (20, 40):
        docs = spark.createDataFrame([(f"d{i}", MARKDOWN) for i in range(n)], "doc string, markdown string")
        whole = structure.blocks_of(docs)
        monkeypatch.setattr(structure, "TASK_BYTES", len(MARKDOWN.encode()))
        fine = structure.blocks_of(docs)
        monkeypatch.undo()
        told[n] = fine.rdd.getNumPartitions()
        assert sorted(map(str, fine.collect())) == sorted(map(str, whole.collect()))
    assert told == {20: 20, 40: 40}


def test_furniture_and_index_as_frames(spark):
    docs = spark.createDataFrame([("d", MARKDOWN), ("e", MARKDOWN[:300])], "doc string, markdown string")
    lines = structure.lines(structure.segments(docs))
    found = {(r.doc, r.bare) for r in structure.furniture(lines).collect()}
    assert found == {("d", "BANK MANUAL"), *(("d", f"Page {n} of 6") for n in range(1, 7))}
    index = {r.number: r.title for r in structure.contents_index(lines).where("doc = 'd'").collect()}
    assert index["1.1"] == "Risk Categories" and index["1.2"] == "Limits"


def test_breadcrumbs_equal_a_stack(spark):
    rng = random.Random(2)
    rows = [(f"d{k % 3}", k, rng.choice(["heading", "paragraph"]), rng.randint(1, 6), "", f"T{k}") for k in range(300)]
    got = {(r.doc, r.pos): r.section for r in structure.breadcrumbs(spark.createDataFrame(rows, "doc string, pos int, kind string, level int, number string, title string")).collect()}
    for doc in ("d0", "d1", "d2"):
        stack = []
        for d, pos, kind, level, _, title in rows:
            if d == doc:
                if kind == "heading":
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, title))
                assert got[d, pos] == " > ".join(t for _, t in stack)


SENTENCE = "This sentence has several words in it and it ends here. "
BLOCK = "doc string, pos int, kind string, text string, page int, level int, number string, title string"


def chunks_of(spark, blocks, cfg=Chunking(), title="Title", year=2024):
    """blocks: (kind, text, page[, level, number, title])."""
    rows = [("doc", i, *b, *((0, "", "") if len(b) == 3 else ())) for i, b in enumerate(blocks)]
    facts = spark.createDataFrame([("doc", title, "fam", year)], "doc_id string, title string, policy_family string, year int")
    return chunking.packed(spark.createDataFrame(rows, BLOCK), facts, cfg).orderBy("ordinal").collect()


def body(text):
    return text.split("\n\n", 1)[1] if text.startswith("[") and "\n\n" in text else text


def test_chunks(spark):
    p = lambda text, page=1: ("paragraph", text, page)
    table = ("table", "\n".join(f"| {i} | x |" for i in range(120)), 2)
    head = ("heading", "1 Scope", 1, 1, "1", "Scope")
    out = chunks_of(spark, [head, *(p(SENTENCE * 20, k) for k in range(1, 8)), table, p("tiny note of only a few words more")])
    assert all(c.text.startswith("[Title (2024) — 1 Scope]\n\n") and c.section_number == "1" for c in out)
    assert sum(c.kind == "table" for c in out) >= 1 and any("| 119 | x |" in c.text and "| 0 | x |" in c.text for c in out)
    prose = [c for c in out if c.kind == "prose"]
    assert len(prose) > 1
    for a, b in zip(prose, prose[1:]):  # overlap is whole sentences of the chunk before
        assert body(b.text).split("\n\n")[0] in body(a.text)
    pages = "(" + ", ".join(map(str, out[0].pages)) + (",)" if len(out[0].pages) == 1 else ")")
    assert out[0].chunk_id == "doc:" + hashlib.sha256(f"doc|0|1 Scope|{pages}|{body(out[0].text)}".encode()).hexdigest()[:16]
    assert chunks_of(spark, [p("too few words")]) == []
    joined = chunks_of(spark, [head, p("Prepared by the whole office of risk:"), table], year=None)
    assert len(joined) == 1 and joined[0].kind == "table"


def plain_chunks(blocks, cfg):
    """(text, kind, pages) of each chunk, from the rules as they are stated: no shared code with the operator."""
    cost = lambda t: max(1, len(t) // 4)
    trail, runs = [], [([], "")]  # enclosing headings; (blocks, section) between headings and tables
    for kind, text, page, *h in blocks:
        if kind == "heading":
            trail = [x for x in trail if x[0] < h[0]] + [(h[0], f"{h[1]} {h[2]}".strip())]
        where = " > ".join(t for _, t in trail)
        if kind != "paragraph":
            runs.append(([(kind, text, page)] if kind == "table" else [], where))
            runs.append(([], where)) if kind == "table" else None
        else:
            runs[-1][0].append((kind, text, page))
    made = []  # section, text, pages, kind
    for own, where in runs:
        last, pack = "", []
        packs = []
        for b in own:
            if pack and cost("\n\n".join(x[1] for x in [*pack, b])) > cfg.target_tokens:
                packs.append(pack)
                pack = []
            pack = [*pack, b]
        for pack in [*packs, *([pack] if pack else [])]:
            text = "\n\n".join(filter(None, [last, "\n\n".join(x[1] for x in pack)]))
            made.append([where, f"[T — {where}]\n\n{text}" if where else f"[T]\n\n{text}", {x[2] for x in pack}, "table" if pack[0][0] == "table" else "prose"])
            every = [x.strip() for x in re.split("(?<=[.!?])\\s+(?=[A-Z(])", text)]
            fits = [n for n in range(2, len(every) + 1) if sum(cost(x) for x in every[-n:]) <= cfg.overlap_tokens]
            last = "" if pack[0][0] == "table" else " ".join(every[-max([1, *fits]) :])
    near = lambda a, b: a[0] == b[0] and cost(a[1]) + cost(b[1]) <= cfg.target_tokens * cfg.slack
    both = lambda a, b: [a[0], f"{a[1]}\n\n{body(b[1])}", a[2] | b[2], "table" if "table" in (a[3], b[3]) else "prose"]
    done = []
    while made:
        one, made = made[0], made[1:]
        if cost(one[1]) >= cfg.min_tokens:
            done.append(one)
        elif made and near(one, made[0]):
            done.append(both(one, made[0]))
            made = made[1:]
        elif done and near(done[-1], one):
            done[-1] = both(done[-1], one)
        else:
            done.append(one)
    return [(t, k, sorted(p)) for _, t, p, k in done if k == "table" or len(body(t).split()) >= cfg.min_words]


def test_chunks_against_the_rules(spark):
    """Every chunk of many random documents, recomputed plainly."""
    rng = random.Random(5)
    cfg = Chunking(target_tokens=60, overlap_tokens=20, min_tokens=15, min_words=4)
    documents = {}
    for d in range(40):
        blocks = []
        for _ in range(rng.randint(1, 30)):
            x, page = rng.random(), rng.randint(1, 4)
            if x < 0.2:
                level = rng.randint(1, 3)
                blocks.append(("heading", "h", page, level, rng.choice(["", "1", "2.1"]), f"Head {rng.randint(1, 9)}"))
            elif x < 0.3:
                blocks.append(("table", "| a | b |\n" * rng.randint(1, 20) + "| c |", page))
            else:
                blocks.append(("paragraph", " ".join(rng.choice(["A short one.", "Yes.", "This sentence is of middling length, no more.", "no end", "(Why not?) Because it is so."]) for _ in range(rng.randint(1, 7))), page))
        documents[f"d{d}"] = blocks
    rows = [(d, i, *b, *((0, "", "") if len(b) == 3 else ())) for d, bs in documents.items() for i, b in enumerate(bs)]
    facts = spark.createDataFrame([(d, "T", "f", None) for d in documents], "doc_id string, title string, policy_family string, year int")
    got = {}
    for r in chunking.packed(spark.createDataFrame(rows, BLOCK), facts, cfg).orderBy("ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.kind, r.pages))
    assert sum(map(len, got.values())) > 200
    for d, bs in documents.items():
        assert got.get(d, []) == plain_chunks(bs, cfg), d


def test_chunks_by_a_tokenizer(spark):
    """Packs filled by a tokenizer's counts of the blocks; a chunk's tokens are those of its text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.functions.tokens import counts_of

    path = public_tokenizers.path("word_bpe_49k.json")
    made = Tokenizer.from_file(path)
    count = lambda t: len(made.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["loan", "Zinsänderungsrisiko", "of", "2024-05", "limit."]) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    rows = [("d", i, "paragraph", t, 1, 0, "", "") for i, t in enumerate(texts)]
    facts = spark.createDataFrame([("d", "T", "f", None)], "doc_id string, title string, policy_family string, year int")
    got = chunking.packed(spark.createDataFrame(rows, BLOCK), facts, Chunking(target_tokens=120, overlap_tokens=0, min_tokens=0, min_words=1), counts_of(spark, path)).orderBy("ordinal").collect()
    packs = [[]]
    for t in texts:
        if packs[-1] and sum(map(count, packs[-1])) + count(t) > 120:
            packs.append([])
        packs[-1].append(t)
    assert [r.text for r in got] == ["[T]\n\n" + "\n\n".join(p) for p in packs] and [r.tokens for r in got] == [count(r.text) for r in got]


def test_chunked_frame(spark):
    docs = spark.createDataFrame([("a", "A", "fam", 2024, MARKDOWN), ("b", "B", "", None, ""), ("c", "C", "", None, None)], "doc_id string, title string, policy_family string, year int, markdown string")
    rows = chunking.chunked(docs, Chunking(min_tokens=1)).collect()
    assert {r.doc_id for r in rows} == {"a"} and len({r.chunk_id for r in rows}) == len(rows)


# Keyword search beside SQLite's FTS5 ------------------------------------------------------------------------------

CORPUS = [
    ("c1", "Donation limits and the approval of donations", "Limits", "A-INST-2025-01"), ("c2", "The board approves every limit", "Approval", ""), ("c3", "Customers are known by café visits", "Know", ""),
    ("c4", "limit limit limit board", "", "A-INST-2024-07"), ("c5", "nothing here", "Board limits", ""), ("c6", "approving donors quickly, the donor relations", "", ""), ("c7", "a an the of", "", ""), ("c8", "other words entirely", "", ""),
]


@pytest.mark.parametrize("question", ["donation limit", "A-INST-2025-01", "board approval board", "cafe", "- ?", '"limits" (approved)', "the", "relations of donors"])
def test_bm25_equals_fts5(spark, question):
    chunks = spark.createDataFrame(CORPUS, "chunk_id string, text string, section string, identifiers string")
    fields = ("text", "section", "identifiers")
    asked = spark.createDataFrame([(1, question)], "qid int, question string")
    got = {r.chunk_id: r.score for r in keyword.bm25(keyword.made_index(chunks, fields), asked, stem=True).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text, section, identifiers, tokenize = 'porter unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", CORPUS)
    terms = [w.strip(".,;:!?()[]{}<>") for w in question.replace('"', "").split()]
    match = " OR ".join(f'"{w}"' for w in terms if w)
    want = dict(db.execute("SELECT id, -bm25(f, 0, 1.0, 0.5, 0.25) FROM f WHERE f MATCH ?", (match,))) if match else {}
    assert set(got) == set(want)
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-8)


def test_dense_is_exact(spark):
    rng = random.Random(8)
    rows = [(f"c{i:03}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [("zero", [0.0] * 8), ("tie1", [1.0] * 8), ("tie2", [2.0] * 8)]
    asked = [(q, [rng.gauss(0, 1) for _ in range(8)]) for q in range(3)] + [(9, [1.0] * 8)]
    got = retrieve.dense(spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(5), spark.createDataFrame(asked, "qid int, embedding array<double>"), k=7).collect()
    for q, v in asked:
        cos = lambda u: sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v)) if any(u) else 0.0  # noqa: B023, E731
        want = sorted(((-round(cos(u), 9), c) for c, u in rows))[:7]
        assert [r.chunk_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [c for _, c in want]


def test_dense_takes_more_questions_than_a_block(spark, monkeypatch):
    rng = random.Random(9)
    vectors = spark.createDataFrame([(f"c{i:03}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [rng.gauss(0, 1) for _ in range(8)]) for q in range(23)] + [(7, [1.0] * 8)], "qid int, embedding array<double>").repartition(4)
    want = sorted(map(tuple, retrieve.dense(vectors, asked, k=5).collect()))
    monkeypatch.setattr(retrieve, "BATCH", 5)
    monkeypatch.setattr(retrieve, "BLOCK", 10)
    assert len(want) == 23 * 5 and sorted(map(tuple, retrieve.dense(vectors, asked, k=5).collect())) == want


def test_fusion_and_refusal(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "w", 1)], "qid int, chunk_id string, rank int")
    f = {(r.qid, r.chunk_id): r for r in retrieve.fuse(a, b).collect()}
    assert f[1, "y"].found_by == "both" and f[1, "x"].found_by == "dense" and f[1, "z"].found_by == "keyword"
    assert abs(f[1, "y"].fused_score - (1 / 62 + 1 / 61)) < 1e-12 and f[1, "y"].fused_rank == 1 and f[1, "x"].fused_rank == 2
    scored = spark.createDataFrame([(1, "y", 0.02, 1, "fam", 2023, "d1"), (1, "x", 0.5, 2, "fam", 2025, "d2"), (2, "w", 0.0199, 1, "", None, "d3")], "qid int, chunk_id string, score double, fused_rank int, policy_family string, year int, doc_id string")
    marked = retrieve.mark_vintages(retrieve.passages(scored))
    rows = {r.chunk_id: r for r in marked.collect()}
    assert set(rows) == {"x", "y"} and rows["y"].superseded and rows["y"].place == 2 and not rows["x"].superseded
    res = {r.qid: r for r in retrieve.results(spark.createDataFrame([(1,), (2,), (3,)], "qid int"), marked).collect()}
    assert res[1].passages == ["x", "y"] and res[1].vintage_conflicts == ["fam"] and res[2].refused and res[3].refused and res[2].passages == []


def test_old_edition_with_a_better_score_still_comes_last(spark):
    rows = spark.createDataFrame([(1, "old", 0.9, 1, "f", 2023, 1), (1, "new", 0.4, 2, "f", 2025, 2), (1, "other", 0.1, 3, "", 2001, 3)], "qid int, chunk_id string, score double, fused_rank int, policy_family string, year int, rank int")
    placed = {r.chunk_id: (r.place, r.superseded) for r in retrieve.mark_vintages(rows).collect()}
    assert placed == {"new": (1, False), "other": (2, False), "old": (3, True)}
    kept = retrieve.mark_vintages(rows, Retrieval(prefer_newest=False)).collect()
    assert [r.chunk_id for r in sorted(kept, key=lambda r: r.place)] == ["old", "new", "other"]


def test_probabilities_squash_whole_lists(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, -3.0), (2, 0.5)], "qid int, s double")
    got = {(r.qid, r.s): r.p for r in df.select("qid", "s", retrieve.probabilities(F.col("s")).alias("p")).collect()}
    assert got[1, 0.2] == 0.2 and abs(got[2, 0.5] - 1 / (1 + math.exp(-0.5))) < 1e-12


# Answers ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,n,clean,cited,invented",
    [("A [1]. B [2][9].", 8, "A [1]. B [2].", [1, 2], [9]), ("[0] x [123]", 3, " x [123]", [], [0]), ("none", 2, "none", [], []), ("[3] [03]", 3, "[3] [03]", [3], []), ("[l](u) [1", 1, "[l](u) [1", [], []), ("x [1]", 0, "x ", [], [1])],
)
def test_citations(spark, text, n, clean, cited, invented):
    a = spark.createDataFrame([(text, n)], "t string, n int").select(answer.audit(F.col("t"), F.col("n")).alias("a")).first().a
    assert (a.clean, a.cited, a.invented) == (clean, cited, invented)
    assert a.unused == [i for i in range(1, n + 1) if i not in cited]


def test_prompt_and_frames(spark):
    block = spark.range(1).select(answer.passage_block(F.lit(2), F.lit("T"), F.lit(2023), F.lit(True), F.lit("1 S"), F.lit(7), F.lit(" text ")).alias("b")).first().b
    assert block == "[2] T (2023) — SUPERSEDED, a newer edition is also below\n    Section: 1 S\n    Page: 7\n\ntext"
    body = 'event: step\ndata: {"a":1}\n\nevent: done\ndata: {}\n\nevent: del'
    got = spark.createDataFrame([(body,)], "b string").select(answer.frames(F.col("b")).alias("f")).first().f
    assert [(f.event, f.data) for f in got] == [("step", '{"a":1}'), ("done", "{}")]
    res = spark.createDataFrame([(1, ["a", "b"], False), (2, [], True), (3, ["a"], False)], "qid int, passages array<string>, refused boolean")
    said = spark.createDataFrame([(1, "See [2][7].")], "qid int, text string")
    events = {}
    for r in sorted(answer.event_rows(res, said).collect(), key=lambda r: (r.qid, r.seq)):
        events.setdefault(r.qid, []).append((r.kind, r.payload))
    assert [k for k, _ in events[1]] == ["step", "step", "sources", "step", "delta", "done"] and events[1][4][1] == "See [2]."
    assert events[2] == [("step", "searching"), ("sources", "0"), ("delta", REFUSAL), ("done", "refused")]
    assert events[3][-1][0] == "error"
    p = answer.prompts(spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "qid int, place int, block string"), spark.createDataFrame([(1, "why?"), (2, "no")], "qid int, question string")).collect()
    assert len(p) == 1 and p[0].prompt.index("A\n\n---\n\nB") > p[0].prompt.index("why?") and p[0].prompt.endswith("why?") and REFUSAL in answer.RULES


# Audit and library ----------------------------------------------------------------------------------------------------


def record(**kw):
    return {"document": "d", "page": 1, "strategy": "ocr", "reason": "", "text": "fine", "error": "", "deferred": False, "warnings": []} | kw


@pytest.mark.parametrize(
    "changes,checks",
    [
        ({}, []), ({"strategy": "skip", "text": ""}, []), ({"error": "boom", "text": ""}, ["extraction-failed"]), ({"deferred": True, "text": ""}, ["never-extracted"]), ({"text": " "}, ["no-text"]),
        ({"text": "![x](y)"}, ["fabricated-image"]), ({"text": "a�b"}, ["encoding-damage"]), ({"reason": "holds 1 table", "text": "prose"}, ["table-lost"]), ({"reason": "holds 1 table", "text": "| a | b |\n| c | d |"}, []),
        ({"warnings": ["Repetition loop", "empty output; recovered on retry"]}, ["engine-warning", "engine-warning"]),
    ],
)
def test_findings(spark, changes, checks):
    schema = "document string, page int, strategy string, reason string, text string, error string, deferred boolean, warnings array<string>"
    r = record(**changes)
    found = audit.findings(spark.createDataFrame([tuple(r.values())], schema)).collect()
    assert [f.check for f in found] == checks
    if len(checks) == 2:
        assert [f.severity for f in found] == ["error", "warning"]


def test_agreement(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = spark.createDataFrame([(long, long), (long, "other things"), ("short", "short")], "a string, b string").select(audit.agreement("a", "b").alias("r")).collect()
    assert rows[0].r == 1.0 and rows[1].r == 0.0 and rows[2].r is None


def test_copies_keep_the_canonical_name(spark):
    files = spark.createDataFrame([("h1", "Report (1).pdf"), ("h1", "Report.pdf"), ("h1", "A longer report.pdf"), ("h2", "x.pdf")], "sha256 string, name string")
    assert {r.name: r.duplicate_of for r in library.copies(files).collect()} == {"Report (1).pdf": "Report.pdf", "Report.pdf": None, "A longer report.pdf": "Report.pdf", "x.pdf": None}


def test_empty_family_never_groups(spark):
    docs = spark.createDataFrame([("a", "", 2023), ("b", "", 2024), ("c", "f", 2023), ("d", "f", None)], "doc_id string, policy_family string, year int")
    assert {r.doc_id: r.has_other_vintage for r in library.other_vintage(docs).collect()} == {"a": False, "b": False, "c": True, "d": True}
    assert [(r.policy_family, r.years) for r in library.families(docs).collect()] == [("f", [2023, 0])]


def test_bench_picks_spread_over_documents(spark):
    rows = [(f"d{i % 2}", i, 30.0, 0.5, 100.0, 0.0, "scanned", True, 0.5) for i in range(4)] + [("d2", 9, 30.0, 0.0, 0.0, 0.0, "digital", False, 0.1)]
    scored = pages.bench_scores(spark.createDataFrame(rows, "doc string, page int, char_density double, raster_coverage double, raster_dpi double, garble double, kind string, has_full_page_raster boolean, table_score double"))
    picks = {r.category: r.doc for r in pages.bench_picks(scored).collect()}
    assert set(picks) == {"poor_scan", "mixed", "full_scan", "dense_table", "clean_digital"} and picks["poor_scan"] != picks["mixed"] and picks["clean_digital"] == "d2"


def test_sources_of_texts_cut_before_they_are_ranked(spark):
    """What is ranked with a passage is no more of its text than its source shows."""
    from quire.plans.text_catalogue import marked

    texts = ["", "short ", "é😀 " * 100 + "x", *(("ab " * 90)[:n] for n in (239, 240, 241, 242))]
    rows = spark.createDataFrame([(1, i, i, "t", "s", 1, 2024, False, text, 0.5) for i, text in enumerate(texts)], "qid int, place int, doc_id int, title string, section string, page int, year int, superseded boolean, text string, score double")
    shown = lambda df: sorted((r.n, r.excerpt) for r in answer.sources(df).collect())
    assert shown(rows.withColumn("text", answer.shown_of(F.col("text")))) == shown(rows)
    at = "/root/testdata/sf0.001"
    whole = {(r.qid, r.chunk_id): r.text for r in marked(spark, at).select("qid", "chunk_id", "text").collect()}
    cut = {(r.qid, r.chunk_id): r.text for r in marked(spark, at, answer.SHOWN).select("qid", "chunk_id", "text").collect()}
    assert max(map(len, whole.values())) > 241 and cut == {k: t[:241] for k, t in whole.items()}


# What packing by a tokenizer asks and reads --------------------------------------------------------------------------


def test_counts_that_add_up_are_asked_of_what_stands_ahead_only(spark):
    """A chunk's tokens are those of its whole text, with the tail of the one before, though its blocks are not counted again."""
    from quire.functions import text as tx

    asked = []

    def count(c):
        asked.append(str(c))
        return F.size(tx.words(F.coalesce(c, F.lit(""))))

    count.adds = True
    rng = random.Random(3)
    kinds = ["paragraph"] * 30 + ["heading", "table"] * 3
    rng.shuffle(kinds)
    rows = [("d", i, k, "| a | b |\n| c | d |" if k == "table" else "Two words" if k == "heading" else SENTENCE * rng.randint(1, 6), 1, int(k == "heading"), "", f"Part {i}") for i, k in enumerate(kinds)]
    facts = spark.createDataFrame([("d", "T", "f", 2024)], "doc_id string, title string, policy_family string, year int")
    got = chunking.packed(spark.createDataFrame(rows, BLOCK), facts, Chunking(target_tokens=60, overlap_tokens=40, min_tokens=0, min_words=1), count).collect()
    assert len(got) > 10 and any(r.kind == "table" for r in got) and max(r.text.count("This sentence") for r in got) > 3
    assert [r.tokens for r in got] == [len(r.text.split()) for r in got]
    assert len(asked) == 2 and "tail" in asked[1] and "text" not in asked[1]


ODD_LINES = [
    "HOUSE MANUAL", "## HOUSE MANUAL ##", "Page 12", "Page 13 ", "\xa0 3. Limits", "1. Scope ... 4", "| 2 | Limits | 7 |", "|3.1 Ends|9", "4. Late  12", "", "   ", "x" * 91, "x" * 90, "7", "12 | Page", "***", "CONTENTS", "1. Scope 5", "5. Five\t6\xa0",
]


def test_facts_of_documents_come_of_their_telling_lines(spark):
    """Furniture and contents of few lines are those of all lines, also with other line ends and an id that stands twice."""
    from quire.functions import text as tx

    rng = random.Random(11)
    page = lambda n: f"<!-- page {n} | digital | text layer -->" + "".join(rng.choice(ODD_LINES) + rng.choice(["\n", "\n", "\r\n", "\r", "\x0b", " ", "\x1c"]) for _ in range(rng.randint(0, 12)))
    rows = [(f"d{i % 25}", "ahead\n" + "".join(page(rng.randint(1, 6)) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc string, markdown string")
    every, told = structure.lines(structure.segments(docs)), structure._telling(docs)
    plain = [(d, m, re.split(structure.MARKER, t)) for d, t in rows for m in [re.findall(structure.MARKER, t)]]
    want = sorted((d, int(p[4 * k + 1]), line) for d, m, p in plain for k in range(len(m)) for line in re.split(structure.LINE_END, p[4 * k + 4]))
    assert sorted((r.doc, r.page, r.line) for r in every.collect()) == want
    noises: dict = {}
    for r in structure.furniture(every).collect():
        noises.setdefault(r.doc, set()).add(r.bare)
    assert noises and {r.doc: set(r.noises) for r in structure._noises(told).collect()} == noises
    first: dict = {}
    for r in sorted(every.collect(), key=lambda r: (r.doc, r.page, r.pos)):
        m = re.match(structure.NUMBERED, r.line.strip(tx.SPACES).strip("|").strip(tx.SPACES), re.ASCII)
        title = re.sub(structure.TRAILING_PAGE, "", m[2].strip(tx.SPACES), flags=re.ASCII) if m else ""
        if m and title != m[2].strip(tx.SPACES) and title.strip(" .…*"):
            at = first.setdefault((r.doc, m[1]), (r.page, r.pos, set()))
            at[2].update({title.strip(" .…*")} if at[:2] == (r.page, r.pos) else ())
    for found in (structure.contents_index(every), structure._contents(told.where("line IS NOT NULL"), "doc", F.col("line"))):
        index = {(r.doc, r.number): r.title for r in found.collect()}
        assert index.keys() == first.keys() and all(t in first[k][2] for k, t in index.items())


def test_a_pattern_found_at_the_beginning_or_not_at_all(spark):
    lines = ["1.2 Scope", "  3. x", "x 1. y", "## Two #", "a ## b", "Annexure B - Forms", " * appendix", "the annexure", "**bold**", "x **bold**", "Contents", "* contents *", "1.", "", "12 | Page", "•"]
    patterns = [structure.NUMBERED, structure.ATX, structure.ANNEXURE, structure.CONTENTS, structure.BOLD]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select(*(F.struct((structure.found(F.col("line"), p) != "").alias("a"), structure.found(F.col("line"), p).alias("g"), F.col("line").rlike(p).alias("b"), F.regexp_extract("line", p, 1).alias("h")).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    for r in got:
        assert all(x.a == x.b and x.g == x.h for x in r)


def test_tails_of_long_texts(spark):
    """The end of a text that is cut alone gives the tail of the whole text."""
    from quire.functions import text as tx

    rng = random.Random(6)
    some = ["Yes. ", "A short one! ", SENTENCE, "no end ", "(Why?) ", "\n\n", "\xa0", "W" * 700 + ". ", "Long " * 300 + "end. ", "Ärger. Ösen? "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(150)]

    def tail(text, budget):
        taken, used = [], 0
        for s in reversed([s for s in (x.strip(tx.SPACES) for x in re.split(r"(?<=[.!?])" + tx.SPACE + r"+(?=[A-Z(\"'“])", text)) if s]):
            cost = max(1, len(s) // 4)
            if taken and used + cost > budget:
                break
            taken, used = [s, *taken], used + cost
        return " ".join(taken)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(tx.overlap_tail(F.col("t"), b).alias(f"b{b}") for b in (5, 40, 120)), *(tx.has_words(F.col("t"), n).alias(f"n{n}") for n in (0, 1, 6)))
    for r in df.collect():
        assert [r.b5, r.b40, r.b120] == [tail(r.t, b) for b in (5, 40, 120)]
        assert [r.n0, r.n1, r.n6] == [len([w for w in re.split(tx.SPACE + "+", r.t) if w]) >= n for n in (0, 1, 6)]
