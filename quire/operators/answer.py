"""Prompts, citations and events of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import REFUSAL
from quire.functions.text import strip

RULES = f"""Answer from the numbered passages only.
Put the number of its passage after every statement, as [1] or [1][3].
If the passages hold no answer, say exactly "{REFUSAL}" and nothing else.
Give amounts, limits, dates and approvers only as a passage words them.
A passage marked SUPERSEDED is from an older edition: prefer the newer one, and say so when you cite it.
Where editions differ, state the current rule first, then the older one.
Quote the wording of obligations. Be brief and use markdown."""

#: Characters of a passage that its source shows.
SHOWN = 240


def passage_block(n: Column, title: Column, year: Column, superseded: Column, section: Column, page: Column, text: Column) -> Column:
    """One numbered passage: what it is, where it stands, its text."""
    return F.concat(
        F.lit("["), n.cast("string"), F.lit("] "), title,
        F.when(year.isNotNull() & (year != 0), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""),
        F.when(superseded, " — SUPERSEDED, a newer edition is also below").otherwise(""),
        F.when(section != "", F.concat(F.lit("\n    Section: "), section)).otherwise(""),
        F.lit("\n    Page: "), page.cast("string"), F.lit("\n\n"), strip(text),
    )


def prompts(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, prompt of each question that has passages (qid, place, block); the question stands before and after them."""
    blocks = passages.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda p: p["block"]), "\n\n---\n\n").alias("blocks"))
    return questions.join(blocks, "qid").select(
        "qid", F.concat(F.lit("Question: "), "question", F.lit("\n\nPassages:\n\n"), "blocks", F.lit("\n\nQuestion: "), "question").alias("prompt")
    )


def cited(answer: Column) -> Column:
    """All citation numbers of an answer in order; [123] is none."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))


def audit(answer: Column, n_sources: Column, superseded: Column | None = None) -> Column:
    """clean text without invented citations, and the numbers that are valid, invented, unused, superseded."""
    every = F.array_distinct(cited(answer))
    ok = lambda n: (n >= 1) & (n <= n_sources)
    valid = F.array_sort(F.filter(every, ok))
    invented = F.array_sort(F.filter(every, lambda n: ~ok(n)))
    marks = F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(r"\[\d{1,2}\]"), F.lit(0)), lambda m: ~ok(F.btrim(m, F.lit("[]")).cast("int"))))
    clean = F.aggregate(marks, answer, lambda text, m: F.replace(text, m, F.lit("")))
    all_of = F.when(n_sources >= 1, F.sequence(F.lit(1), F.greatest(n_sources, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    old = superseded if superseded is not None else F.array().cast("array<int>")
    return F.struct(
        clean.alias("clean"), valid.alias("cited"), invented.alias("invented"), F.array_except(all_of, valid).alias("unused"),
        F.array_sort(F.array_intersect(valid, old)).alias("superseded"),
    )


def note(invented: Column, unused: Column, superseded: Column) -> Column:
    """What a reader is told of an answer's citations."""
    return F.concat_ws(
        " ",
        F.when(F.size(invented) > 0, F.concat(F.size(invented).cast("string"), F.lit(" invented citation(s) removed."))),
        F.when(F.size(superseded) > 0, F.lit("Cites a superseded edition.")),
        F.when(F.size(unused) > 0, F.concat(F.size(unused).cast("string"), F.lit(" source(s) not cited."))),
    )


def frame(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def frames(body: Column) -> Column:
    """(event, data) of each frame of a stream's text; an unfinished last frame is left out."""
    parts = F.split(body, "\n\n")
    whole = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    return F.transform(whole, lambda p: F.struct(F.regexp_extract(p, "(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(p, "(?m)^data: (.*)$", 1).alias("data")))


def event_rows(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, seq, kind, payload): step, step, sources, step, delta, done; a refusal is step, sources, delta, done without a model.

    results: qid, passages, refused. answers: qid, text (missing: an error event ends the row's events).
    """
    joined = results.join(answers, "qid", "left")
    row = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    n = F.size("passages")
    refused = F.array(row("step", F.lit("searching")), row("sources", F.lit(0)), row("delta", F.lit(REFUSAL)), row("done", F.lit("refused")))
    head = [row("step", F.lit("searching")), row("step", F.lit("reading")), row("sources", n), row("step", F.lit("writing"))]
    failed = F.array(*head, row("error", F.lit("no answer")))
    told = F.array(*head, row("delta", audit(F.col("text"), n)["clean"]), row("done", F.lit("answered")))
    events = F.when(F.col("refused"), refused).when(F.col("text").isNull(), failed).otherwise(told)
    return joined.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.kind", "e.payload")


def messages(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, system, user of each question that has passages: what a chat model is sent."""
    return prompts(passages, questions).select("qid", F.lit(RULES).alias("system"), F.col("prompt").alias("user"))


def shown_of(text: Column, most: int = SHOWN) -> Column:
    """As much of a text as ``sources`` needs: it may stand for the text before passages are ranked."""
    return F.left(text, F.lit(most + 1))


def sources(passages: DataFrame, most: int = SHOWN) -> DataFrame:
    """What is shown of each passage: its number, document, section, page, edition, the beginning of its text, its score."""
    shown = F.when(F.length("text") > most, F.concat(F.rtrim(F.left("text", F.lit(most))), F.lit("…"))).otherwise(F.col("text"))
    return passages.select("qid", F.col("place").alias("n"), "doc_id", "title", "section", "page", "year", "superseded", shown.alias("excerpt"), F.round("score", 4).alias("score"))


def whole(results: DataFrame, said: DataFrame) -> DataFrame:
    """qid, status, text, cited of each question: the audited answer, the refusal, or an error where a model said nothing."""
    n = F.size("passages")
    rows = results.join(said.select("qid", F.col("text").alias("said")), "qid", "left").withColumn("a", audit(F.coalesce("said", F.lit("")), n))
    status = F.when(F.col("refused"), "refused").when(F.coalesce(strip(F.col("said")), F.lit("")) == "", "error").otherwise("answered")
    none = F.array().cast("array<int>")
    return rows.select("qid", status.alias("status"), F.when(F.col("refused"), REFUSAL).when(status == "error", "").otherwise(F.col("a.clean")).alias("text"), F.when(status == "answered", F.col("a.cited")).otherwise(none).alias("cited"))
