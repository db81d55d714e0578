"""Bounded-space online packing of token ids into sequences.

Each partition keeps ``open_windows`` windows. A document's ids (longer ones first cut into whole sequences) go to the
open window that they fit best. When none has room, the fullest one is filled up with the document's first ids and
emitted, and the rest is placed on. At the end of a partition its windows are merged into full sequences and one
remainder. Remainders are merged ``fan_in`` partitions at a time, round after round, so no task gathers more than
``fan_in`` remainders, however many partitions there are. The last remainder is cut into lengths that are powers of two.

Stage one's pieces are written to the checkpoint folder, so tokenizing happens once, and a lost executor's part is made
again with the same sequences (ids depend on the partition's number only).

Defined results: null or empty text is the end id alone; every row is packed, repeated rows too; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.word_cache import WordCache, flat

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids array<int>"
ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")), ("ids", pa.list_(pa.int32()))])


MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts on which every built encoder is verified: letters that decompose, special tokens in any case, odd spaces.
PROBES = ["", " ", "a", "Plain words, and 12 numbers!", "İ! क़, ڦ. שׁ! \u0344! ﬁ! ß! Σς!", "<|ENDOFTEXT|> <|endoftext|> x<|StartOfText|>y", "tab\tnbsp\u00a0thin\u2009line\u2028end\r\n", "don't 'Tis I'LL it's'", "e\u0301! a \u0308 =\u0338 <\u0338!", "日本語。テキスト! 한국어, \u1112\u1161\u11ab!", "x" * 300 + "!" * 300, "𝔘! 🙂!"]


class Encoder:
    """Token ids of texts, as ``Tokenizer.encode`` gives them.

    The pre-tokenizer never joins what a blank or line end parts, so a text's ids are those of its words, and each
    distinct word is encoded once. A word of ``plain`` letters and the ASCII marks after it is joined from its two parts;
    plain letters are those of which the file's own normaliser and pre-tokenizer make a word apart from a mark. If any
    probe has other ids this way, whole texts are encoded instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = made = Tokenizer.from_file(path)
        self.special = [t.content for t in made.get_added_tokens_decoder().values()]
        self.lowers = self._apart("A") == self._apart("a")
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(one := self._apart(c)) == 1 and self._apart(c + "!") == [*one, *self._apart("!")])
        cut = re.compile(f"([{letters}]+)([{re.escape(MARKS)}]+)") if letters else re.compile("(?!)")
        self.cache = WordCache(self._words, parts=lambda w: m.groups() if w[-1:] in MARKS and (m := cut.fullmatch(w)) else None)
        self.by_word = True
        for probe in PROBES:
            if self.ids([probe])[0].tolist() != made.encode(probe, add_special_tokens=False).ids:
                self.by_word = False

    def _apart(self, text: str) -> list[str]:
        """The pieces that are merged within."""
        text = self.made.normalizer.normalize_str(text) if self.made.normalizer else text
        return [p for p, _ in self.made.pre_tokenizer.pre_tokenize_str(text)] if self.made.pre_tokenizer else [text]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.made.encode(words, is_pretokenized=True, add_special_tokens=False)  # one call for all words
        return np.array(got.ids, dtype=np.uint32), np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(words))

    def split(self, text: str) -> list[str]:
        """Cut at blanks and line ends. ASCII is lowered, so that fewer words differ, if the tokenizer does so itself and
        no special token comes of it (those are looked up in the text as it is)."""
        if self.lowers and text.isascii():
            low = text.lower()
            if not any(s in low for s in self.special):
                text = low
        return text.replace("\n", " ").split(" ")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one entry more than texts)."""
        if self.by_word:
            return self.cache.ids([self.split(t) for t in texts])
        ids, lengths = flat([e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)])
        return ids, np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, verified when built."""
    return Encoder(path)


class Packer:
    """Pieces are tuples (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, open_windows: int, base: int):
        self.capacity, self.most, self.next = capacity, open_windows, base
        self.open: list[tuple[int, list]] = []  # (ids used, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def put(self, k: int, piece: tuple) -> None:
        used, pieces = self.open[k]
        pieces.append(piece)
        used += len(piece[2])
        if used == self.capacity:
            self.emit(pieces)
            self.open.pop(k)
        else:
            self.open[k] = (used, pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.capacity:
            self.emit([(doc, start, ids[: self.capacity], total)])
            ids, start = ids[self.capacity :], start + self.capacity
        while len(ids):
            fits = [(used, k) for k, (used, _) in enumerate(self.open) if used + len(ids) <= self.capacity]
            if fits:
                self.put(max(fits)[1], (doc, start, ids, total))
                return
            if len(self.open) < self.most:
                self.open.append((0, []))
                self.put(len(self.open) - 1, (doc, start, ids, total))
                return
            used, k = max((used, k) for k, (used, _) in enumerate(self.open))
            room = self.capacity - used
            self.put(k, (doc, start, ids[:room], total))
            ids, start = ids[room:], start + room

    def merge(self) -> list:
        """Fills full sequences from the open windows; the pieces that are left, under a capacity in all."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open, self.most = [], 1
        for doc, start, ids, total in left:
            self.add(doc, start, ids, total)
        return self.open[0][1] if self.open else []

    def powers(self, pieces: list) -> None:
        """Emits the pieces in sequences whose lengths are powers of two, largest first."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now, rest = [], []
            for doc, start, ids, total in pieces:
                take = min(size, len(ids))
                size -= take
                if take:
                    now.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
            self.emit(now)
            pieces = rest

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, open_windows: int = 16, fan_in: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    common.small_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        packer = Packer(capacity, open_windows, part << 32)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for some in common.slices(batch):
                every, at = words.ids([t or "" for t in some.column(1).to_pylist()])
                for doc, a, b in zip(some.column(0).to_pylist(), at[:-1], at[1:]):
                    packer.add(doc, 0, np.concatenate([every[a:b], end]), int(b - a) + 1)
                yield packer.flush()
        left = packer.merge()
        packer.rows += [(doc, start, len(ids), None, total, None, None, part, ids.astype(np.int32)) for doc, start, ids, total in left]
        yield packer.flush()

    def join(round_no: int, last: bool):
        def run(key, parts):  # without annotations: half of them would be taken as a form of their own
            group = key[0].as_py()
            packer = Packer(capacity, 1, ((round_no + 1) << 56) + (group << 32))
            parts = parts.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
            for r in parts.to_pylist():
                packer.add(r["doc_id"], r["start"], np.array(r["ids"], dtype=np.uint32), r["doc_tokens"])
            left = packer.open[0][1] if packer.open else []
            if last:
                packer.powers(left)
            else:
                packer.rows += [(doc, start, len(ids), None, total, None, None, group, ids.astype(np.int32)) for doc, start, ids, total in left]
            return pa.Table.from_batches([packer.flush()])

        return run

    done = []
    now = common.checkpointed(docs.select("doc_id", "text").mapInArrow(first, SCHEMA))
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    for round_no in range(1, 64):
        done.append(now.where("part IS NULL"))
        last = parts <= fan_in
        left = now.where("part IS NOT NULL").withColumn("group", F.expr(f"part div {fan_in}"))
        now = left.groupBy("group").applyInArrow(join(round_no, last), SCHEMA)
        if last:
            done.append(now)
            break
        now = common.checkpointed(now)
        parts = -(-parts // fan_in)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
