"""Benchmark passages in documents: Wu-Manber search for many patterns at once, over words in place of letters.

A window is ten consecutive words of an item; an item of fewer words, but not none, is one window. Windows of one length form
a ``Table``: a block is two words (one, where windows have one). The shift table says for a block's hash how far the search may
move on without missing a window, nine words where the block is in none. Where it says zero, the block ends a window: the
bucket of its hash holds the windows that end so, told apart by the hash of their other words, and the words themselves are
compared before a window counts as found.

Texts are searched in lanes, runs of positions that move on in step, so that a step is a handful of array operations over
all lanes of two megabytes of text; only words that the search stops at are hashed. Long texts are searched in pieces that
share nine words.

The items are collected and broadcast in blocks of about ``BLOCK`` bytes of text (long items in pieces of windows), one pass
over the documents a block; with more than one, the places that the passes find are put together by document.

Defined results: null text has no words; rows that repeat an id are rows like any other; an item given twice, or in rows of
different texts, counts once; items without an id mark words as hit, but are neither counted nor named; without items
nothing is hit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

WIDTH = 10
#: Bytes of item text in a block, words of a piece of an item, positions of a lane, bytes of text searched at once.
BLOCK, PIECE, LANE, AT_ONCE = 2_000_000, 2_000, 512, 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "doc_id long, digest string, n_words long, spans array<long>, items array<string>"

#: Each byte lowered, separators as a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Words:
    """The words of texts that stand one after another, each text's apart: where each begins and ends, and of which text it is."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join([*texts, b" " * 8]).translate(_PLAIN)  # eight bytes can be read anywhere
        letters = np.frombuffer(self.data, dtype=np.uint8) != 32
        edge = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        if letters[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.start, ends)  # of each text, the number of the word behind its own
        self.first = np.concatenate([[0], self.last[:-1]])
        self._eight = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Of the words of these numbers, by length and their first and last eight bytes: equal words have equal ones."""
        start, size = self.start[at], self.end[at] - self.start[at]
        some = np.minimum(size, 8)
        with np.errstate(over="ignore"):
            h = (self._eight[start] & _LOW[some]) * _MUL[0] + (self._eight[start + size - some] & _LOW[some]) * _MUL[1] + size.astype(np.uint64)
            h ^= h >> np.uint64(29)
            return h * _MUL[2]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, b not included, with single spaces."""
        return b" ".join(self.data[self.start[a] : self.end[b - 1]].split())


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), dtype=np.uint64)
        for p in parts:
            h = (h ^ p) * _MUL[0]
            h ^= h >> np.uint64(32)
    return h


@dataclass
class Table:
    """Windows of ``width`` words, found by their last block."""

    width: int
    items: dict[bytes, set] = field(default_factory=lambda: defaultdict(set))

    def built(self) -> Table:
        """Fills the tables from ``items`` (window: ids)."""
        self.windows = list(self.items)
        self.block = min(2, self.width)
        words = Words(self.windows)
        bits = max(12, int(4 * len(self.windows) * self.width).bit_length())
        self.bits = np.uint64(64 - min(bits, 24))
        self.shift = np.full(1 << (64 - int(self.bits)), self.width - self.block + 1, dtype=np.uint8 if self.width < 256 else np.int32)
        for j in range(self.block - 1, self.width):
            np.minimum.at(self.shift, self._slot(words, words.first + j), self.width - 1 - j)
        last = words.first + self.width - 1
        key = self._key(words, last)
        order = np.argsort(key, kind="stable")
        self.keys, self.order = key[order], order
        return self

    def _slot(self, words: Words, last: np.ndarray) -> np.ndarray:
        """The place in the shift table of the block that ends at each word."""
        return (_joined([words.hashes(last - i) for i in range(self.block)]) >> self.bits).astype(np.int64)

    def _key(self, words: Words, last: np.ndarray) -> np.ndarray:
        """Bucket and rest: the slot of the last block above, the hash of the words before it below."""
        rest = [words.hashes(last - i) for i in range(self.block, self.width)]
        low = _joined(rest) >> np.uint64(32) if rest else np.zeros(len(last), dtype=np.uint64)
        return (self._slot(words, last).astype(np.uint64) << np.uint64(32)) | low

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(number of its last word, window) of every window in the texts."""
        pos, end = [], []
        for a, b in zip((words.first + self.width - 1).tolist(), words.last.tolist()):
            if a < b:
                some = np.arange(a, b, LANE)
                pos.append(some)
                end.append(np.minimum(some + LANE, b))
        if not pos:
            return
        pos, end, stops = np.concatenate(pos), np.concatenate(end), []
        while len(pos):
            move = self.shift[self._slot(words, pos)].astype(np.int64)
            here = move == 0
            if here.any():
                stops.append(pos[here])
                move[here] = 1
            pos = pos + move
            on = pos < end
            if not on.all():
                pos, end = pos[on], end[on]
        if not stops:
            return
        stops = np.concatenate(stops)
        key = self._key(words, stops)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        for i in np.flatnonzero(low < high):
            at = int(stops[i])
            text = words.text(at - self.width + 1, at + 1)
            for w in self.order[low[i] : high[i]]:
                if self.windows[w] == text:
                    yield at, int(w)


class Searcher:
    """All windows of a block of items."""

    def __init__(self, pieces: list[tuple[str | None, str]]):
        tables: dict[int, Table] = {}
        for item, text in pieces:
            own = text.encode("utf-8", "replace").split(b" ")
            width = min(WIDTH, len(own))
            table = tables.setdefault(width, Table(width))
            for i in range(len(own) - width + 1):
                table.items[b" ".join(own[i : i + width])].add(item)
        self.tables = [t.built() for t in tables.values()]

    def found(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Of each text the number of words, the merged runs of words that are hit, and the items."""
        out: list = [None] * len(texts)
        run: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > AT_ONCE:
                out[i] = self._long(text)
                continue
            run.append(i)
            size += len(text)
            if size >= AT_ONCE:
                self._some(texts, run, out)
                run, size = [], 0
        self._some(texts, run, out)
        return out

    def _some(self, texts: list[bytes], run: list[int], out: list) -> None:
        if not run:
            return
        words = Words([texts[i] for i in run])
        spans: list[list] = [[] for _ in run]
        items: list[set] = [set() for _ in run]
        for at, width, ids in self._places(words):
            k = int(np.searchsorted(words.last, at, side="right"))
            spans[k].append((at - width + 1 - int(words.first[k]), at + 1 - int(words.first[k])))
            items[k] |= ids
        for k, i in enumerate(run):
            out[i] = int(words.last[k] - words.first[k]), merged(spans[k]), items[k]

    def _places(self, words: Words) -> Iterator[tuple[int, int, set]]:
        for table in self.tables:
            for at, w in table.search(words):
                yield at, table.width, table.items[table.windows[w]]

    def _long(self, text: bytes) -> tuple[int, list, set]:
        """A text of any length, in pieces; each begins with the last nine words of the one before."""
        text = text.translate(_PLAIN)
        begin, before, size, spans, items = 0, 0, AT_ONCE, [], set()
        while True:
            stop = text.find(b" ", begin + size)
            words = Words([text[begin : stop if stop >= 0 else len(text)]])
            own = len(words.start)
            if stop >= 0 and own < WIDTH:  # words longer than the piece
                size *= 2
                continue
            for at, width, ids in self._places(words):
                spans.append((before + at - width + 1, before + at + 1))
                items |= ids
            spans = merged(spans)
            if stop < 0:
                return before + own, spans, items
            kept = WIDTH - 1
            begin, before, size = begin + int(words.start[own - kept]), before + own - kept, AT_ONCE


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_array(c: Column) -> Column:
    low = F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def pieces_of(items: DataFrame) -> DataFrame:
    """(item, piece): the words of each item, in pieces that hold ``PIECE`` windows at most and together hold all."""
    own = items.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WIDTH, F.lit(0)), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(PIECE + WIDTH - 1)), " "))
    return own.select("item", F.explode(cut).alias("piece")).distinct()


def blocks_of(items: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[str | None, str]]]:
    """The pieces of all items in lists of about ``most`` bytes, one on the driver at a time."""
    pieces = common.checkpointed(pieces_of(items))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("piece") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // most))
    for k in range(n):
        of = F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == k
        yield [(r.item, r.piece) for r in pieces.where(of).collect()]


def found(docs: DataFrame, pieces: list[tuple[str | None, str]]) -> DataFrame:
    """doc_id, digest of the text, n_words, spans (begin and end of each run of hit words), items: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(shared.value)
        for batch in batches:
            for part in common.slices(batch):
                rows = search.found([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()])
                spans = [[x for s in r[1] for x in s] for r in rows]
                # Items without an id stand as null.
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([[i for i in r[2] if i is not None] for r in rows], pa.list_(pa.string()))],
                    names=["doc_id", "digest", "n_words", "spans", "items"],
                )

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text").mapInArrow(run, FOUND)


def told(rows: DataFrame) -> DataFrame:
    """The columns of the result, from rows of ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n, sha = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                runs = merged(list(zip(spans[::2], spans[1::2])))
                names = sorted(set(items))
                hit.append(sum(b - a for a, b in runs))
                n.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return rows.select("doc_id", "n_words", "spans", "items").mapInArrow(run, SCHEMA)


def marked(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document (doc_id, text) against items (item_id, text)."""
    passes = [found(docs, pieces) for pieces in blocks_of(items, block)]
    if len(passes) == 1:
        return told(passes[0])
    # Equal rows have equal places, so those of a row are found again by its id and its text's digest.
    hits = reduce(DataFrame.union, (p.where(F.size("spans") > 0) for p in passes))
    each = hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    same = own["doc_id"].eqNullSafe(each["doc_id"]) & (own["digest"] == each["digest"])
    none = F.array().cast("array<long>")
    both = own.join(each, same, "left")
    return told(both.select(own["doc_id"], own["n_words"], F.coalesce(each["spans"], none).alias("spans"), F.coalesce(each["items"], F.array().cast("array<string>")).alias("items")))


_SPLIT = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"

#: The windows as strings, joined to those of the documents.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS l FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS l FROM benchmark),
s AS (SELECT item, l, unnest(range(greatest(len(l) - {WIDTH - 1}, 1))) AS pos FROM i WHERE len(l) > 0),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(l), {WIDTH}) AS n, array_to_string(l[pos + 1 : pos + {WIDTH}], ' ') AS w FROM s),
e AS (SELECT r, l, k.n, unnest(range(len(l) - k.n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM p) AS k WHERE len(l) >= k.n),
h AS MATERIALIZED (SELECT e.r, e.pos, e.n, p.item FROM (SELECT r, pos, n, array_to_string(l[pos + 1 : pos + n], ' ') AS w FROM e) AS e JOIN p ON p.n = e.n AND p.w = e.w),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)"""
