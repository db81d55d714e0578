"""Toxicity by compression distance.

Two dictionaries share a base that zstandard's trainer makes of ordinary text; the toxic one has toxic content behind it,
so a window's two compressed sizes differ only by what that content saves. The content is no trained dictionary: its
segments are chosen by class contrast (frequent in toxic training texts, nearly absent from the ordinary ones), as two
dictionaries that the trainer makes of either class apart do not tell the classes (the README has the figures).
Every window of a text is compressed with both; the largest and the mean saving, over several window sizes, give a
score by a calibration fitted on training rows that the dictionaries did not see.

Defined results: null or empty text has no windows and scores as a text without any saving; texts of any length are
scored whole; equal texts score alike; an empty table gives an empty result; without labels of both classes the
score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.compression import fit_logistic, probability, sampled, sizes, train, windows

#: (window bytes, level, mirrored: the ordinary dictionary also gets the toxic content, reversed, so both are equally long)
PASSES = ((64, 3, False), (64, 3, True), (48, 1, True))
TRIM = b".,;:!?*#$%&|\"'()[]{}<>=-_/\\"


@dataclass(frozen=True)
class ToxicityModel:
    pairs: tuple[tuple[int, int, bytes, bytes], ...]  # window, level, ordinary, toxic
    weights: tuple[float, ...]
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 3 * len(self.pairs)))
        lowered = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        for k, (size, level, ordinary, toxic) in enumerate(self.pairs):
            parts = [windows(t, size) for t in lowered]
            flat = [w for p in parts for w in p]
            saved = sizes(flat, ordinary, level) - sizes(flat, toxic, level)
            at = 0
            for i, p in enumerate(parts):
                if p:
                    own = saved[at : at + len(p)]
                    out[i, 3 * k : 3 * k + 3] = own.max(), own.mean(), min(4, (own >= 3).sum())
                    at += len(p)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.pairs:
            return np.full(len(texts), self.prior)
        return probability(self.features(texts), np.array(self.weights))


def forms(text: str) -> set[bytes]:
    """The words of a text and their beginnings of 4 to 14 bytes."""
    out = set()
    for w in set(text.lower().encode("utf-8", "replace").split()):
        w = w.strip(TRIM)
        out.update(w[:k] for k in range(4, min(len(w), 14) + 1))
    return out


def toxic_content(toxic: list[str], ordinary: list[str], least: float = 0.04, ratio: float = 20) -> bytes:
    """Segments for the toxic dictionary: in at least ``least`` of the toxic texts, ``ratio`` times as often as in ordinary ones."""
    found = Counter(f for t in toxic for f in forms(t))
    # So many occurrences that chance would hardly put them all on the toxic side (odds of e^-11).
    sure = 11 / math.log((len(toxic) + len(ordinary)) / len(toxic))
    found = {f: n for f, n in found.items() if n >= max(4, sure, least * len(toxic))}
    other: Counter[bytes] = Counter()
    for t in ordinary:
        other.update(forms(t) & found.keys())
    strong = []
    for f, n in found.items():
        a, b = n / len(toxic), (other[f] + 0.5) / len(ordinary)
        if a > ratio * b:
            strong.append((n * math.log(a / b), f))
    strong.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    kept: list[bytes] = []
    for _, f in strong:
        if not any(f.startswith(k) or k.startswith(f) for k in kept):
            kept.append(f)
    return b" " + b" ".join(reversed(kept)) + b" " if kept else b""


def dictionaries(rows: list[tuple[str, int]], dictionary_bytes: int, base_windows: int) -> tuple[tuple[int, int, bytes, bytes], ...]:
    toxic = [t for t, v in rows if v]
    ordinary = [t for t, v in rows if not v]
    content = toxic_content(toxic, ordinary)
    base = train(sampled([t.lower().encode("utf-8", "replace") for t in ordinary], 64, base_windows), dictionary_bytes)
    return tuple((size, level, base + content[::-1] if mirrored else base, base + content) for size, level, mirrored in PASSES)


def fit(rows: list[tuple[str, int]], dictionary_bytes: int = 8192, folds: int = 3, base_windows: int = 80_000) -> ToxicityModel:
    """Every row serves both ends: the calibration sees savings under dictionaries of the other folds, and the final
    dictionaries come from all rows. The base is trained on ``base_windows`` windows at most, dealt over all ordinary
    texts and their whole length."""
    y = np.array([r[1] for r in rows], dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    if y.sum() < 8 or (1 - y).sum() < 8:
        return ToxicityModel((), (), prior)
    rank = np.empty(len(y), dtype=int)  # folds with equal shares of either label
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        rank[at] = np.arange(len(at)) % folds
    seen, marks = [], []
    for k in range(folds):
        part = ToxicityModel(dictionaries([r for r, f in zip(rows, rank) if f != k], dictionary_bytes, base_windows), (), prior)
        seen.append(part.features([r[0] for r, f in zip(rows, rank) if f == k]))
        marks.append(y[rank == k])
    weights = fit_logistic(np.vstack(seen), np.concatenate(marks), ridge=1e-2)
    return ToxicityModel(dictionaries(rows, dictionary_bytes, base_windows), tuple(weights), prior)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (columns doc_id, text; others are not read)."""

    def run(x: dict[str, list]) -> dict:
        s = model.score(x["text"])
        return {"doc_id": x["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    out = common.text_map(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 9000, max_chars: int = 30_000) -> ToxicityModel:
    """Fitted on a bounded sample: at most ``max_rows`` labelled rows of at most ``max_chars`` characters."""
    return fit(common.labelled(docs, labels, "toxic", max_rows, max_chars))
