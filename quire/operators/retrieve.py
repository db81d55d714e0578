"""From ranked lists to passages: dense search, fusion, reranking, refusal, editions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import Retrieval
from quire.functions.text import once, words
from quire.functions.vectors import cosine
from quire.operators.keyword import top

#: Questions that one pass over the vectors takes: a stated block, so the broadcast matrix is small by construction.
BATCH = 10_000
#: Scores that a task holds at once.
BLOCK = 4_000_000
#: Pairs of a question and a key that are broadcast, and values of a key that a filter lists.
PAIRS, LISTED = 200_000, 1_000


def dense(vectors: DataFrame, questions: DataFrame, k: int = 30) -> DataFrame:
    """qid, chunk_id, score, rank: exact cosine top-k. vectors (chunk_id, embedding), questions (qid, embedding).

    The questions are broadcast matrices of at most BATCH rows, one pass over the vectors for each. Each batch of vectors
    is scored by a matrix product and a partition keeps the best k of each question, so k rows per question and partition
    are shuffled, never the pairs. Scores are rounded to nine digits, so ranks do not depend on the order of summation.
    """
    asked = questions.select("qid", "embedding").limit(BATCH + 1).collect()
    if len(asked) <= BATCH:
        return _dense_block(vectors, questions, asked, k)
    blocks = _blocks(questions.select("qid", "embedding"))
    return reduce(DataFrame.union, (_dense_block(vectors, questions, b, k) for b in blocks))


def _blocks(questions: DataFrame) -> Iterator[list]:
    """All questions in runs of at most BATCH rows. The driver holds a partition of them at a time, and the run.

    Equal qids share a run, as their candidates are ranked together; more than BATCH rows of one qid are one run.
    """
    run: list = []
    for r in questions.orderBy("qid").toLocalIterator():
        if len(run) >= BATCH and r.qid != run[-1].qid:
            yield run
            run = []
        run.append(r)
    yield run


def _dense_block(vectors: DataFrame, questions: DataFrame, asked: list, k: int) -> DataFrame:
    ids = [r.qid for r in asked]
    matrix = vectors.sparkSession.sparkContext.broadcast(_units([r.embedding for r in asked]))
    fields = {f.name: f.dataType.simpleString() for f in [*questions.select("qid").schema, *vectors.select("chunk_id").schema]}
    schema = f"qid {fields['qid']}, chunk_id {fields['chunk_id']}, score double"

    def run(frames):
        best: list[pd.DataFrame] = []
        step = max(k, BLOCK // max(1, len(ids)))
        names_of = np.array(ids, dtype=object)
        for f in frames:
            for i in range(0, len(f) if ids else 0, step):  # so many rows that their scores take bounded memory
                part = f.iloc[i : i + step]
                scores = np.round(_units(part["embedding"].tolist()) @ matrix.value.T, 9)
                keep = min(k, len(part))
                least = -np.partition(-scores, keep - 1, axis=0)[keep - 1]
                row, q = np.nonzero(scores >= least)  # ties with the last one, too: their names decide
                best.append(_best(pd.DataFrame({"qid": names_of[q], "chunk_id": part["chunk_id"].to_numpy()[row], "score": scores[row, q]}), k))
                if len(best) > 8:
                    best = [_best(pd.concat(best), k)]
        if best:
            yield _best(pd.concat(best), k)

    return top(vectors.select("chunk_id", "embedding").mapInPandas(run, schema), k)


def _units(rows: list) -> np.ndarray:
    x = np.array([r for r in rows], dtype=np.float64).reshape(len(rows), -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["qid", "score", "chunk_id"], ascending=[True, False, True]).groupby("qid", sort=False).head(k)


def dense_within(vectors: DataFrame, questions: DataFrame, only: DataFrame, k: int = 30, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As ``dense``, each question within what it may see: vectors (chunk_id, keys, embedding), only (qid, keys).

    If questions and pairs are few (BATCH and PAIRS), vectors stay where they are: those of other keys are filtered out by
    values (of a table partitioned by keys, its other partitions are not read), and of each batch the rows of one key meet
    the questions of that key. Else vectors are joined with their questions.
    """
    asked = questions.select("qid", "embedding").limit(BATCH + 1).collect()
    pairs = only.select("qid", *keys).distinct().limit(PAIRS + 1).collect() if len(asked) <= BATCH else []
    if len(asked) > BATCH or len(pairs) > PAIRS:
        both = vectors.join(only.distinct(), [*keys]).join(questions.select("qid", F.col("embedding").alias("asked")), "qid")
        return top(both.select("qid", "chunk_id", F.round(cosine(F.col("embedding"), F.col("asked")), 9).alias("score")), k)
    for i, key in enumerate(keys, 1):
        values = {r[i] for r in pairs} - {None}
        if len(values) <= LISTED:
            vectors = vectors.where(F.col(key).isin(list(values)))
    units = dict(zip((r.qid for r in asked), _units([r.embedding for r in asked])))
    of: dict[tuple, list] = {}
    for r in pairs:
        if r.qid in units and None not in r[1:]:
            of.setdefault(tuple(r[1:]), []).append(r.qid)
    shared = vectors.sparkSession.sparkContext.broadcast((units, of))
    fields = {f.name: f.dataType.simpleString() for f in [*questions.select("qid").schema, *vectors.select("chunk_id").schema]}
    schema = f"qid {fields['qid']}, chunk_id {fields['chunk_id']}, score double"

    def run(frames):
        units, of = shared.value
        best: list[pd.DataFrame] = []
        for f in frames:
            for key, rows in f.groupby(list(keys), sort=False):
                ids = of.get(key if isinstance(key, tuple) else (key,), [])
                step = max(k, BLOCK // max(1, len(ids)))
                for i in range(0, len(rows) if ids else 0, step):
                    part = rows.iloc[i : i + step]
                    scores = np.round(_units(part["embedding"].tolist()) @ np.array([units[q] for q in ids]).T, 9)
                    made = pd.DataFrame({"qid": np.tile(np.array(ids, dtype=object), len(part)), "chunk_id": np.repeat(part["chunk_id"].to_numpy(), len(ids)), "score": scores.ravel()})
                    best.append(_best(made, k))
            if len(best) > 8:
                best = [_best(pd.concat(best), k)]
        if best:
            yield _best(pd.concat(best), k)

    return top(vectors.select("chunk_id", *keys, "embedding").mapInPandas(run, schema), k)


def fuse(dense_list: DataFrame, keyword_list: DataFrame, k: int = 60, limit: int = 30) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, chunk_id, rank); found_by says which list had the chunk."""
    a = dense_list.select("qid", "chunk_id", F.col("rank").alias("dense_rank"))
    b = keyword_list.select("qid", "chunk_id", F.col("rank").alias("keyword_rank"))
    share = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = a.join(b, ["qid", "chunk_id"], "full_outer").withColumn("fused_score", share("dense_rank") + share("keyword_rank"))
    by = F.when(F.col("dense_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "dense").otherwise("both")
    w = Window.partitionBy("qid").orderBy(F.desc("fused_score"), F.coalesce("dense_rank", F.lit(1_000_000)), "chunk_id")
    return both.withColumn("found_by", by).withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= limit)


def rerank_text(title: Column, circular: Column, section: Column, text: Column) -> Column:
    """What a reranker reads: the parts of the heading that exist, and the text."""
    head = F.array_join(F.filter(F.array(title, circular, section), lambda x: F.trim(x) != ""), " · ")
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def candidates(hits: DataFrame, questions: DataFrame, chunks: DataFrame, per_question: int = 30, most: int = 200_000) -> DataFrame:
    """hits (qid, chunk_id, ...; at most ``per_question`` of each question) with their question's and chunk's columns.

    If the questions are so few that their hits are ``most`` at most, the hits are broadcast to the chunks, of which only
    those that were hit are kept where they are read; else both sides are shuffled."""
    few = questions.limit(most // per_question + 1).count() <= most // per_question
    hint = F.broadcast if few else lambda side: side
    return chunks.join(hint(hits.join(hint(questions), "qid")), "chunk_id")


def scored(rows: DataFrame, score: Column) -> DataFrame:
    """rows with ``score``, as the variable of a lambda, so that filters and sorts above do not compute it anew."""
    return rows.withColumn("score", once(score, lambda s: s))


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of the question's distinct words that the passage has."""
    q = F.array_distinct(words(F.lower(question)))
    return F.size(F.array_intersect(q, words(F.lower(passage)))) / F.greatest(F.size(q), F.lit(1))


def probabilities(score: Column, qid: str = "qid") -> Column:
    """A question's scores through the logistic function if any of them is outside 0 to 1."""
    w = Window.partitionBy(qid)
    outside = (F.min(score).over(w) < 0) | (F.max(score).over(w) > 1)
    return F.when(outside, 1 / (1 + F.exp(-score))).otherwise(score)


def passages(scored: DataFrame, cfg: Retrieval = Retrieval(), threshold: bool = True) -> DataFrame:
    """The best top_k chunks of each question with score at least the threshold (qid, chunk_id, score, fused_rank)."""
    kept = scored.where(F.col("score") >= cfg.min_score) if threshold else scored
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "fused_rank", "chunk_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_k)


def mark_vintages(found: DataFrame, cfg: Retrieval = Retrieval(), index_wide: DataFrame | None = None) -> DataFrame:
    """superseded: a newer edition of the family is among the question's passages; such passages come last, never drop.

    ``index_wide`` (policy_family, newest) compares with all that is indexed instead.
    """
    if index_wide is None:
        newest = F.max("year").over(Window.partitionBy("qid", "policy_family"))
        marked = found.withColumn("newest", newest)
    else:
        marked = found.join(index_wide, "policy_family", "left")
    old = (F.col("policy_family") != "") & (F.col("year") < F.col("newest"))
    marked = marked.withColumn("superseded", F.coalesce(old, F.lit(False))).drop("newest")
    last = F.col("superseded").cast("int") if cfg.prefer_newest else F.lit(0)
    w = Window.partitionBy("qid").orderBy(last, F.desc("score"), "rank")
    return marked.withColumn("place", F.row_number().over(w))


def results(questions: DataFrame, marked: DataFrame) -> DataFrame:
    """One row per question, refused ones too: passages in order, distinct documents, families with editions in conflict."""
    per = marked.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.round("score", 4).alias("score")))), lambda p: p["chunk_id"]).alias("passages"),
        F.countDistinct("doc_id").alias("document_count"),
        F.array_sort(F.collect_set(F.when(F.col("superseded"), F.col("policy_family")))).alias("vintage_conflicts"),
    )
    out = questions.select("qid").join(per, "qid", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "qid", F.coalesce("passages", none).alias("passages"), F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("vintage_conflicts", none).alias("vintage_conflicts"), F.col("passages").isNull().alias("refused"),
    )


def with_facts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with its document's title, circular, family and year; a document that the registry does not know is titled by its id."""
    facts = docs.select("doc_id", "title", "circular", "policy_family", "year")
    out = found.join(facts, "doc_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.withColumns({"title": F.coalesce("title", F.col("doc_id").cast("string")), "circular": blank("circular"), "policy_family": blank("policy_family")})


def stage_counts(questions: DataFrame, **stages: DataFrame) -> DataFrame:
    """Per question how many rows each named stage kept, and ``reason`` why it is refused: blank question, nothing found,
    nothing above the threshold (the last stage), else null."""
    out = questions.select("qid", (F.coalesce(F.btrim("question"), F.lit("")) == "").alias("blank"))
    for name, rows in stages.items():
        out = out.join(rows.groupBy("qid").agg(F.count("*").alias(name)), "qid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    last = [*stages][-1]
    reason = F.when(F.col("blank"), "blank question").when(F.greatest(*(F.col(s) for s in stages)) == 0, "nothing found").when(F.col(last) == 0, "nothing above the threshold")
    return out.select("qid", *stages, reason.alias("reason"))
