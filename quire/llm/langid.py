"""Language identification with a blended-spectrum string kernel.

A text is the set of its 1- to 3-grams over lowered code points (what is no letter is a gap); the kernel is the number of
shared grams over the root of the product of the set sizes. A few landmark texts of each language span a Nyström
approximation, in which one ridge regression per language (one against the rest) is solved. Documents are scored in
batches: a presence matrix times the landmarks' matrix gives kernel values, and these times the weights the scores.

Defined results: null text and text without a letter are ``und`` with score 0; texts are taken whole; equal texts score
alike; ties go to the first language in order of its name; an empty table gives an empty result; if nothing can be
learned every document is ``und``; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common

#: Grams are hashed to so many numbers; the languages of one model use some tens of thousands of grams.
SPACE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, stamp: np.ndarray) -> np.ndarray:
    """Sorted numbers of the distinct grams of a text, of one to three code points; ``stamp`` is a scratch array of SPACE longs."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where(_letters()[code], code, 0).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    every = np.concatenate([c | np.uint64(3 << 62), two | np.uint64(1 << 63), two[:-1] << np.uint64(21) | c[2:]])
    with np.errstate(over="ignore"):
        every = (every * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    at = np.arange(len(every))
    stamp[every] = at
    return np.sort(every[stamp[every] == at])  # the last of equal numbers


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    column: np.ndarray  # of each gram in the landmarks' matrix, or -1
    landmarks: np.ndarray  # grams x landmarks, scaled by the landmarks' norms
    weights: np.ndarray  # landmarks x languages

    def kernel(self, texts: list[str], batch: int = 128) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[1]), dtype=np.float32)
        seen = np.zeros(SPACE, dtype=np.int64)
        for k in range(0, len(texts), batch):
            part = texts[k : k + batch]
            present = np.zeros((len(part), len(self.landmarks)), dtype=np.float32)
            norm = np.ones(len(part), dtype=np.float32)
            for i, t in enumerate(part):
                g = grams(t, seen)
                norm[i] = np.sqrt(max(1, len(g)))
                own = self.column[g]
                present[i, own[own >= 0]] = 1
            out[k : k + len(part)] = present @ self.landmarks / norm[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score = np.zeros(len(texts))
        lang = ["und"] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if at and self.langs:
            s = self.kernel([texts[i] for i in at]).astype(float) @ self.weights
            p = np.exp(4 * (s - s.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for i, best, row in zip(at, s.argmax(1), p):
                lang[i], score[i] = self.langs[best], row[best]
        return lang, score


def fit(rows: list[tuple[str, str]], landmarks: int = 128, ridge: float = 1e-4) -> LanguageModel:
    """From (text, language): landmarks are dealt evenly to the languages, the rest of the rows only train the regressions."""
    rows = [(t, v) for t, v in rows if t and v is not None and LETTER.search(t)]
    langs = tuple(sorted({v for _, v in rows}))
    if not langs:
        return LanguageModel((), np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)))
    each = max(1, landmarks // len(langs))
    chosen = []
    for v in langs:
        own = sorted((t for t, w in rows if w == v), key=len, reverse=True)
        chosen += own[: max(1, len(own) // 2)][:: max(1, len(own) // 2 // each)][:each]
    seen = np.zeros(SPACE, dtype=np.int64)
    sets = [grams(t, seen) for t in chosen]
    known = np.unique(np.concatenate(sets))
    column = np.full(SPACE, -1, dtype=np.int32)
    column[known] = np.arange(len(known))
    matrix = np.zeros((len(known), len(chosen)), dtype=np.float32)
    for j, g in enumerate(sets):
        matrix[column[g], j] = 1 / np.sqrt(len(g))
    model = LanguageModel(langs, column, matrix, np.zeros((len(chosen), len(langs))))
    kmm = model.kernel(chosen).astype(float)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2), without its null space
    x = model.kernel([t for t, _ in rows]).astype(float) @ root
    y = np.array([[1.0 if v == w else -1.0 for w in langs] for _, v in rows])
    share = np.maximum(1, (y > 0).sum(0))
    weight = np.array([1 / share[langs.index(v)] for _, v in rows])
    weight *= len(rows) / weight.sum()
    solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * len(rows) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    return LanguageModel(langs, column, matrix, root @ solved)


def learn(docs: DataFrame, rows_per_lang: int = 400, max_rows: int = 40_000, max_chars: int = 20_000) -> LanguageModel:
    """Fitted on a bounded sample: about ``rows_per_lang`` rows that are not held out of every language, fewer where that
    were over ``max_rows`` in all, of texts up to ``max_chars``, chosen by the hashes of their ids. (Of over ``max_rows``
    languages the most frequent are learned.)"""
    known = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")) & (F.length("text") <= max_chars))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return fit([])
    whole, each = 1_000_003, min(rows_per_lang, max(1, max_rows // len(counts)))
    wanted = [(r["lang"], min(whole, -(-whole * each // r["count"]))) for r in counts]
    share = docs.sparkSession.createDataFrame(wanted, "lang string, below long")  # at most max_rows rows
    own = known.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(whole)) < F.col("below"))
    rows = own.select("h", "text", "lang").orderBy("h", "text", "lang").limit(2 * each * len(counts)).collect()
    return fit([(r.text, r.lang) for r in rows])


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict:
        lang, score = shared.value.predict(x["text"])
        return {"doc_id": x["doc_id"], "lang_pred": lang, "score": score}

    out = common.text_map(docs, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
