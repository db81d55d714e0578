"""Encoding by distinct words: a text is cut where the tokenizer surely cuts, and each distinct piece is encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice, repeat

import numpy as np


class WordCache:
    """ids of words from a growing table of bounded memory.

    Beyond ``most`` words (some 250 bytes each) or ``most_bytes`` characters of words it shrinks to its first ``keep``
    and half the characters: frequent words come early, and those that come late are mostly never seen again. Words of
    over ``long`` characters leave the table after the call that brought them, so texts without spaces do not fill it.

    ``encode`` gives the ids of words one after another and how many each has. ``parts`` may cut a word in two whose ids are those of its parts one after another.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 900_000, keep: int = 550_000, parts: Callable[[str], tuple[str, str] | None] | None = None, most_bytes: int = 32_000_000, long: int = 64):
        self.encode, self.most, self.keep, self.parts, self.most_bytes, self.long = encode, most, keep, parts, most_bytes, long
        self.clear()

    def shrink(self) -> None:
        sizes = np.cumsum(np.fromiter(map(len, self.at), dtype=np.int64, count=len(self.at)))
        kept = min(self.keep, int(np.searchsorted(sizes, self.most_bytes // 2, side="right")))
        self._truncate(kept)
        self.durable, self.bytes = kept, int(sizes[kept - 1]) if kept else 0

    def _truncate(self, n: int) -> None:
        """Only the first n words stay."""
        if len(self.at) > n:
            self.used = int(self.starts[n])
            if len(self.at) - n < n:
                for _ in range(len(self.at) - n):
                    self.at.popitem()
            else:
                self.at = dict(islice(self.at.items(), n))

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.uint32)
        self.used = self.durable = self.bytes = 0

    def add(self, words: list[str]) -> None:
        """Puts distinct new words into the table, the long ones last and for one call only."""
        long = [w for w in words if len(w) > self.long]
        if long:
            words = [w for w in words if len(w) <= self.long]
        self._add(words)
        self.durable = len(self.at)
        if long:
            self._add([w for w in long if w not in self.at])

    def _add(self, words: list[str]) -> None:
        """Words that ``parts`` cuts are joined from their parts' ids."""
        cut = {w: p for w in words if (p := self.parts(w))} if self.parts else {}
        plain = [w for w in words if w not in cut]
        if cut:
            at, own = self.at, set(plain)
            plain += [w for w in dict.fromkeys(p for pair in cut.values() for p in pair) if w not in at and w not in own and w not in cut]
        if plain:
            ids, lengths = self.encode(plain)
            self._append(plain, lengths, ids)
        if cut:
            at, starts, size, pool = self.at, self.starts, self.lengths, self.pool
            index = np.fromiter((at[p] for pair in cut.values() for p in pair), dtype=np.int64, count=2 * len(cut))
            flat = _gather(pool, starts[index], size[index])
            self._append(list(cut), size[index].reshape(-1, 2).sum(1), flat)

    def _append(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        first, n = len(self.at), len(self.at) + len(words)
        self.bytes += sum(map(len, words))
        self.at.update(zip(words, range(first, n)))
        if n > len(self.starts):
            self.starts = np.resize(self.starts, 3 * n // 2)
            self.lengths = np.resize(self.lengths, 3 * n // 2)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 3 * (self.used + len(ids)) // 2)
        self.lengths[first:n] = lengths
        self.starts[first:n] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one entry more than texts)."""
        if len(self.at) > self.durable:
            self.bytes -= sum(map(len, islice(self.at, self.durable, None)))
            self._truncate(self.durable)
        if len(self.at) > self.most or self.bytes > self.most_bytes:
            self.shrink()
        at = self.at
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        line = list(chain.from_iterable(texts))
        index = np.fromiter(map(at.get, line, repeat(-1)), dtype=np.int64, count=len(line))
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            words = [line[i] for i in unknown.tolist()]
            self.add(list(dict.fromkeys(words)))
            index[unknown] = np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        flat = _gather(self.pool, self.starts[index], lengths)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, bounds


def flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as ``encode`` gives them."""
    lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
    return np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(lengths.sum())), lengths


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of pool at starts, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int32)  # a pool has far under 2^31 ids
    at += np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    return pool.take(at)
