"""Quality by compression: the normalised difference of a text's sizes under a good and a bad dictionary.

One zstandard dictionary is trained on windows of good labelled texts, one on those of bad ones. A text's windows are
compressed with each; (good size - bad size) / (their sum) is the normalised difference, and a calibration on rows
that the dictionaries did not see turns it into a score. Added to the method: the plain compression ratio, which tells
endless repetition, stands beside the difference in the calibration (the README has the figures without it).

Defined results: null or empty text scores 0.5 x the share of good labels, having nothing to judge; every text is
scored whole; equal texts score alike; an empty table gives an empty result; without labels of both classes the score
is the share of good labels (1 without labels, so that nothing is rejected unjudged).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.compression import fit_logistic, probability, sampled, sizes, train, windows

LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    window: int = 512

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        parts = [windows(t.encode("utf-8", "replace"), self.window) for t in texts]
        flat = [w for p in parts for w in p]
        raw = np.fromiter(map(len, flat), dtype=float, count=len(flat))
        g, b = sizes(flat, self.good, LEVEL).astype(float), sizes(flat, self.bad, LEVEL).astype(float)
        own = sizes(flat, b"", LEVEL).astype(float)  # without a dictionary: shared passages are no repetition
        at = 0
        for i, p in enumerate(parts):
            if p:
                s = slice(at, at + len(p))
                at += len(p)
                gs, bs, rs = g[s].sum(), b[s].sum(), raw[s].sum()
                diff, ratio = (gs - bs) / (gs + bs), own[s].sum() / (rs + 12 * len(p))
                out[i] = diff, abs(diff), ratio, ratio * ratio, max(0.0, 0.3 - ratio)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        filled = [t or "" for t in texts]
        s = probability(self.features(filled), np.array(self.weights))
        return np.where([bool(t) for t in filled], s, 0.5 * self.prior)


def fit(rows: list[tuple[str, int]], dictionary_bytes: int = 16_384, dictionary_windows: int = 60_000) -> QualityModel:
    """The dictionaries come from the first half of the rows, the calibration from the rest. Each dictionary is trained on
    ``dictionary_windows`` windows at most, dealt over all its texts and their whole length."""
    y = np.array([r[1] for r in rows], dtype=float)
    prior = float(y.mean()) if len(y) else 1.0
    cut = len(rows) // 2
    good = [t for t, v in rows[:cut] if v and t]
    bad = [t for t, v in rows[:cut] if not v and t]
    if len(good) < 4 or len(bad) < 4 or len(set(y[cut:])) < 2:
        return QualityModel(b"", b"", (), prior)
    made = [train(sampled([t.encode("utf-8", "replace") for t in texts], 256, dictionary_windows), dictionary_bytes) for texts in (good, bad)]
    model = QualityModel(made[0], made[1], (), prior)
    keep = [(t, v) for t, v in rows[cut:] if t]
    weights = fit_logistic(model.features([t for t, _ in keep]), np.array([v for _, v in keep], dtype=float))
    return QualityModel(made[0], made[1], tuple(weights), prior)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 30_000) -> QualityModel:
    """Fitted on a bounded sample: at most ``max_rows`` labelled rows of at most ``max_chars`` characters."""
    return fit(common.labelled(docs, labels, "quality", max_rows, max_chars))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (columns doc_id, text; others are not read)."""

    def run(x: dict[str, list]) -> dict:
        s = model.score(x["text"])
        return {"doc_id": x["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    out = common.text_map(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, every column as it is, whose text scores at least ``threshold``."""
    import pyarrow as pa

    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) >= threshold))

    # Names by position meanwhile: mapInArrow cannot resolve names with dots in them.
    names = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return names.mapInArrow(run, names.schema).toDF(*docs.columns)
