"""Filtered vector search over a partitioned collection, and jobs that stall."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quire.operators import retrieve
from quire.sources.collection import read_vectors, write_vectors
from quire.streaming import ingest

SCHEMA = "chunk_id string, doc_id string, kind string, embedding array<float>, policy_family string, year int"


def test_filtered_search_reads_only_its_partitions(spark, tmp_path, monkeypatch):
    rng, path = random.Random(3), str(tmp_path / "v")
    rows = [(f"c{i:03}", f"d{i % 40}", "prose", [rng.gauss(0, 1) for _ in range(6)], f"f{i % 4}", 2020 + i % 5) for i in range(200)]
    write_vectors(spark.createDataFrame(rows, SCHEMA), path)
    v = read_vectors(spark, path, SCHEMA)
    asked = [(q, [rng.gauss(0, 1) for _ in range(6)]) for q in range(5)]
    only = [(0, "f1", 2021), (1, "f1", 2021), (1, "f1", 2022), (2, "f3", 2023), (3, "f9", 2020), (2, "f3", 2023)]
    questions = spark.createDataFrame(asked, "qid int, embedding array<double>")
    pairs = spark.createDataFrame(only, "qid int, policy_family string, year int")

    def got():
        found = retrieve.dense_within(v, questions, pairs, 4, ("policy_family", "year"))
        return found, {(r.qid, r["rank"]): r.chunk_id for r in found.collect()}

    want = {}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for q, e in asked:
        score = sorted((-round(float(unit(np.float32(r[3]).astype(float)) @ unit(e)), 9), r[0]) for r in rows if (q, r[4], r[5]) in only)
        want |= {(q, i + 1): c for i, (_, c) in enumerate(score[:4])}
    found, blocked = got()
    assert blocked == want and len(want) == 12
    narrow = read_vectors(spark, path, SCHEMA, policy_family=["f1"], year=[2021, 2022])
    files = {r[0] for r in narrow.select(F.input_file_name()).collect()}
    assert files and all("policy_family=f1/" in f and ("year=2021" in f or "year=2022" in f) for f in files)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [policy_family" in plan and "Join" not in plan
    monkeypatch.setattr(retrieve, "PAIRS", 1)
    assert got()[1] == want

    write_vectors(spark.createDataFrame([("new", "d1", "prose", [1.0] * 6, "f1", 2021)], SCHEMA), path)  # replaces one partition
    assert {r.chunk_id for r in read_vectors(spark, path, SCHEMA, policy_family=["f1"], year=[2021]).collect()} == {"new"}
    assert read_vectors(spark, path, SCHEMA).count() == 200 - sum(r[4:] == ("f1", 2021) for r in rows) + 1


def test_jobs_that_say_nothing_fail(spark, tmp_path):
    start = datetime(2024, 5, 1, 12, 0)
    at = lambda m: start + timedelta(minutes=m)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts = [
        [("a", "queued", at(0)), ("b", "queued", at(0)), ("c", "queued", at(1)), ("a", "chunking", at(2))],
        [("b", "chunking", at(8)), ("a", "extracting", at(1)), ("b", "ready", at(9)), ("d", "queued", at(9))],
        [("e", "queued", at(30))],
        [("c", "ready", at(31)), ("e", "queued", at(33)), ("f", "queued", at(60))],
        [("f", "ready", at(61))],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, "job string, state string, at timestamp").coalesce(1).write.mode("append").parquet(src)
            events = spark.readStream.schema("job string, state string, at timestamp").parquet(src)
            ingest.run_all(lambda: ingest.watched(events).writeStream.option("checkpointLocation", cp).option("path", out).format("parquet").trigger(availableNow=True).start())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.at, r.state)):
        got.setdefault(r.job, []).append((r.state, (r.at - start).total_seconds() / 60))
    assert got["a"] == [("queued", 0), ("chunking", 2), ("failed", 12)]
    assert got["b"] == [("queued", 0), ("chunking", 8), ("ready", 9)]
    assert got["c"] == [("queued", 1), ("failed", 11), ("ready", 31)]
    assert got["d"] == [("queued", 9), ("failed", 19)] and got["e"] == [("queued", 30), ("failed", 43)] and got["f"] == [("queued", 60), ("ready", 61)]
