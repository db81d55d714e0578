"""Registered queries beside DuckDB on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not re.match(r"op\d+_", n) and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{D}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_text_layer_reads_whole_texts(spark, duck):
    blocks = {}
    for i, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        # A wrap is a line end with the white space around it.
        one = re.sub(r"[ \t]{2,}", " ", re.sub(r"\.{4,}", "...", re.sub(r"[ \t\n\f\r]*\n[ \t\n\f\r]*", " ", text or ""))).strip(" ")
        blocks.setdefault(i // 10, []).append((i * 7 % 10, i % 3, one))
    want = {p: "\n\n".join(b[2] for b in sorted(of) if b[2]) or None for p, of in blocks.items()}
    got = {r.page: r.text for r in entry.queries()["text_layer"](spark, D).collect()}
    assert max(map(len, (t for t in want.values() if t))) > 10_000 and set(got) == set(want)
    for p in want:
        assert (got[p] or None) == want[p], p


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "passages", "document_count", "vintage_conflicts", "refused"]


def test_library_stands_without_the_pipeline_package(tmp_path):
    """A copy without the package, its tests and corpus_pipeline.py imports and registers everything else."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), len(e.oracle_sql()) > 40)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(OWN)), "False", "False", "True"], said.stderr


def test_agreement_is_not_computed_by_source(spark):
    """Few sources hold all documents, so the pairs of a source are dealt again before they are compared."""
    plan = entry.queries()["prior_agreement"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    compared, dealt = plan.index("ArrowEvalPython"), plan.index("hashpartitioning(doc_id")
    assert compared < dealt < plan.index("hashpartitioning(source")
