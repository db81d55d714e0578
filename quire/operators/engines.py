"""Pluggable engines: extraction by strategy, engine comparison, language models, and what is known of providers.

An engine is a plain function of one page or prompt. It runs in ``mapInPandas``, is made once per task by its factory,
and never stops a job: a failure becomes a row with an error.
"""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import EXTRACTOR_VERSION
from quire.functions.text import degenerate_repeat, strip_images, unfence, words

Factory = Callable[[], Callable[[str], str]]
RECORD = "document string, page int, kind string, strategy string, text string, engine string, seconds double, error string, deferred boolean, extractor_version int"


def extracted(pages: DataFrame, ocr: Factory | None, name: str = "ocr") -> DataFrame:
    """Page records by strategy: skip gives nothing to read, text-layer the layer, ocr the engine's reading, both the two.

    pages: document, page, kind, strategy, layer, image (what the engine takes). Without an engine pages that need one
    are ``deferred``; an engine's failure is the record's error, cut at 400 characters.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = ocr() if ocr else None
        for f in frames:
            rows = []
            for r in f.itertuples():
                text, error, waits, start = "", "", False, time.perf_counter()
                layer, needs = r.layer or "", r.strategy in ("ocr", "both")
                if r.strategy in ("text-layer", "both"):
                    text = layer
                if needs and read is None:
                    waits = True
                elif needs:
                    try:
                        seen = read(r.image or "")
                        text = f"{text}\n\n{seen}".strip() if r.strategy == "both" else seen
                    except Exception as e:  # noqa: BLE001  any engine, any fault: the page says so, the job goes on
                        error = f"{type(e).__name__}: {e}"[:400]
                engine = {"text-layer": "text layer", "both": f"text layer + {name}", "ocr": name}.get(r.strategy, "")
                rows.append((r.document, r.page, r.kind, r.strategy, text, engine, time.perf_counter() - start, error, waits, EXTRACTOR_VERSION))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    return pages.select("document", "page", "kind", "strategy", "layer", "image").mapInPandas(run, RECORD)


def recognised(text: Column, holds_table: Column, tables: Column) -> Column:
    """An engine's output cleaned of an outer fence and invented images, with warnings on what it looks like."""
    clean = strip_images(unfence(text))
    loop = degenerate_repeat(clean)
    warnings = F.array_compact(F.array(
        F.when((clean == "") & (text != ""), "returned only an image placeholder"), F.when(text == "", "empty output"),
        F.when(loop > 0, F.concat(F.lit("repetition loop: one line "), loop.cast("string"), F.lit(" times"))), F.when(holds_table & (tables == 0), "the page holds a table, the output none"),
    ))
    return F.struct(clean.alias("text"), warnings.alias("warnings"))


def retried(read: Callable[[str], str]) -> Callable[[str], str]:
    """An engine that is asked once more if it gives nothing."""
    return lambda image: read(image) or read(image)


def compared(pages: DataFrame, engines: dict[str, Factory]) -> DataFrame:
    """engine, page, ok, error, characters, seconds, text: every engine on every page (a stated, small set of pages).

    An engine that cannot be made fails on all of its pages and is not tried again within a task.
    """
    listed = pages.sparkSession.createDataFrame([(n,) for n in engines], "engine string")
    pairs = pages.select("page", "image").crossJoin(F.broadcast(listed))
    schema = "engine string, page long, ok boolean, error string, characters int, seconds double, text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Callable | Exception] = {}
        for f in frames:
            rows = []
            for r in f.itertuples():
                start = time.perf_counter()
                try:
                    if r.engine not in made:
                        try:
                            made[r.engine] = engines[r.engine]()
                        except Exception as e:  # noqa: BLE001
                            made[r.engine] = e
                    if isinstance(made[r.engine], Exception):
                        raise made[r.engine]
                    text, error = made[r.engine](r.image or ""), ""
                except Exception as e:  # noqa: BLE001
                    text, error = "", f"{type(e).__name__}: {e}"[:400]
                rows.append((r.engine, r.page, not error, error, len(text), time.perf_counter() - start, text))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return pairs.mapInPandas(run, schema)


def extractive(question: Column, passages: Column) -> Column:
    """A stand-in for a language model: of each passage the number, if it shares words with the question, as a cited list."""
    q = F.array_distinct(words(F.lower(question)))
    hits = F.filter(F.transform(passages, lambda p, i: F.when(F.size(F.array_intersect(q, words(F.lower(p)))) > 0, F.concat(F.left(p, F.lit(80)), F.lit(" ["), (i + 1).cast("string"), F.lit("]")))), lambda x: x.isNotNull())
    return F.array_join(hits, "\n")


def streamed(lines: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, text, error) from newline-delimited JSON of a model server: deltas in order up to the line that is done."""
    got = lines.withColumn("j", F.from_json("line", "response string, done boolean, error string"))
    end = got.where("j.done").groupBy(key).agg(F.min("seq").alias("end"))
    kept = got.join(end, key, "left").where("end IS NULL OR seq <= end")
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("j.response", F.lit("")).alias("r"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["r"]), "").alias("text"), F.max("j.error").alias("error"))


def require_local(url: str) -> str:
    """The URL, if its host is this machine or a private one: documents must not leave the premises."""
    host = (urlsplit(url).hostname or "").lower()
    try:
        near = ipaddress.ip_address(host).is_private or ipaddress.ip_address(host).is_loopback
    except ValueError:
        near = host == "localhost" or host.endswith(".local") or (host != "" and "." not in host)
    if not near:
        raise ValueError(f"{url} is not a local address")
    return url


@dataclass(frozen=True)
class Provider:
    """What can be plugged in: its slot, and the module that it needs."""

    name: str
    slot: str
    module: str | None

    def state(self) -> str:
        from importlib.util import find_spec

        return "ready" if self.module is None or find_spec(self.module) else "missing-deps"


PROVIDERS = tuple(
    Provider(*p)
    for p in (("hashing", "embedder", None), ("bge-m3", "embedder", "torch"), ("overlap", "reranker", None), ("cross-encoder", "reranker", "torch"), ("extractive", "llm", None), ("http", "llm", None), ("http", "ocr", None), ("layout", "ocr", "onnxruntime"))
)


def provider_states(slot: str | None = None) -> dict[tuple[str, str], str]:
    return {(p.slot, p.name): p.state() for p in PROVIDERS if slot in (None, p.slot)}
