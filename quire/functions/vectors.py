"""Vector functions in the JVM, and the hashing embedder."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: (x / size).cast("float"))).otherwise(a)


def hashed_vector(text: str, dim: int, width: int = 3) -> np.ndarray:
    """Signed bucket counts of the trigrams of the lowered, squeezed text, at length 1 (blank: zeros)."""
    out = np.zeros(dim, dtype=np.float64)
    line = " ".join((text or "").lower().split())
    for gram, n in Counter(line[i : i + width] for i in range(max(1, len(line) - width + 1)) if line).items():
        h = hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % dim] += n if h[4] & 1 else -n
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def hashing_embedder(dim: int = 1024):
    """A pandas UDF text -> array<float>. Its fingerprint is ``hashing:dim``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t, dim).astype("float32"))

    return embed


def fingerprint(model: str, dim: int) -> str:
    """Name without its path, and dimension: vectors of different fingerprints never mix."""
    return f"{model.replace(chr(92), '/').rstrip('/').split('/')[-1]}:{dim}"
