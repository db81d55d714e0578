"""Shared by the two compression classifiers: windows, dictionaries, paired sizes, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import zstandard as zstd


def windows(data: bytes, size: int) -> list[bytes]:
    """data in consecutive windows of at most ``size`` bytes, cut before a space where one is near."""
    out, i, n = [], 0, len(data)
    while n - i > size:
        j = data.rfind(b" ", i + size // 2, i + size)
        if j < 0:
            j = i + size
        out.append(data[i:j])
        i = j
    if i < n:
        out.append(data[i:])
    return out


def sampled(texts: Sequence[bytes], size: int, most: int) -> list[bytes]:
    """The windows of all texts, every n-th of them where they are over ``most``, so each part of each text has its share."""
    every = [w for t in texts for w in windows(t, size)]
    return every[:: -(-len(every) // most)] if len(every) > most else every


def train(samples: Sequence[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples. The trainer wants some samples and ten times the dictionary's size of
    them; a dictionary of less is asked of fewer, and none (no bytes) of samples that cannot train the least one."""
    size = min(size, sum(map(len, samples)) // 10)
    if size < 512 or len(samples) < 16:
        return b""
    return zstd.train_dictionary(size, list(samples), k=64, d=6, level=3).as_bytes()


@lru_cache(maxsize=16)
def compressor(dictionary: bytes, level: int) -> zstd.ZstdCompressor:
    """Cached in a worker: loading a dictionary costs more than compressing a window with it."""
    plain = dict(level=level, write_content_size=False, write_checksum=False)
    if len(dictionary) < 8:
        return zstd.ZstdCompressor(**plain)
    kept = zstd.ZstdCompressionDict(dictionary)
    kept.precompute_compress(level=level)
    return zstd.ZstdCompressor(dict_data=kept, write_dict_id=False, **plain)


def sizes(parts: Sequence[bytes], dictionary: bytes, level: int) -> np.ndarray:
    c = compressor(dictionary, level)
    return np.fromiter((len(c.compress(p)) for p in parts), dtype=np.int64, count=len(parts))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic calibration (last: intercept) on standardised columns folded back to x."""
    mu, sd = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mu) / sd, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = w[:-1] / sd
    return np.append(out, w[-1] - (out * mu).sum())


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
