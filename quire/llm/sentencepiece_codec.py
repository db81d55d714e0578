"""SentencePiece models on the tokenizers library.

The model file's protobuf is parsed here (no generated classes): pieces with scores and kinds, model type, byte
fallback, normaliser. From these a ``tokenizers`` pipeline is rebuilt: the precompiled character map, white-space
rules, the metaspace marker, then unigram scores or, for BPE models, the merges that the piece scores imply, with byte
fallback. Batches are encoded by the library's own threads. ``verify`` holds the result against the sentencepiece
library and fails on any difference.

If the model has no character map and no piece crosses from a word to a following marker, a text's ids are the ids of
its marker-led words one after another, so each distinct word is encoded once per worker.

Defined results: null text has no ids and decodes to the empty string; empty text has no ids; texts of any length are
encoded whole; repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quire.llm import common
from quire.llm.word_cache import WordCache, flat

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers for varints, bytes for everything else."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"unknown wire type {wire}")
            size = varint()
        yield tag >> 3, data[i : i + size]
        i += size


def parse(data: bytes) -> Model:
    """A serialised ModelProto (fields 1: pieces, 2: trainer_spec, 3: normalizer_spec)."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            p = dict(fields(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    return Model(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, best score first; a piece's own ways by their left part's score."""
    rank = {p: (-s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, own in rank.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in rank and b in rank:
                found.append((own, rank[a], a, b))
    found.sort()
    return [(a, b) for _, _, a, b in found]


def rebuild(model: Model, normalised: bool = True):
    """The ``tokenizers.Tokenizer`` of the model; without ``normalised`` its core alone."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        # Only normal and user pieces may match text: the names of the others get a score that never wins.
        core = models.Unigram([(p, s if kind in (NORMAL, USER) else -1e5) for p, s, kind in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    if normalised:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Replace(" ", MARK)]
        if model.dummy_prefix:
            steps += [normalizers.Prepend(MARK)]
        out.normalizer = normalizers.Sequence(steps)
    user = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        out.add_tokens(user)
    return out


class Codec:
    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = model = parse(data)
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = not model.charsmap and not model.squeeze and model.dummy_prefix and not any(kind == USER or inner.search(p) for p, _, kind in model.pieces)
        self.tokenizer = rebuild(model, not self.by_word)
        self.cache = WordCache(lambda words: flat([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]))
        self.bytes = [self._surface(p, kind) for p, _, kind in model.pieces]

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def words(self, text: str) -> list[str]:
        """The marker-led words of a text, whose ids follow one another."""
        if not text:
            return []
        line = (MARK + text).replace(" ", MARK)
        if MARK * 2 not in line and MARK not in text:
            return (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return re.findall(f"{MARK}+[^{MARK}]*", line)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one entry more than texts)."""
        filled = [t or "" for t in texts]
        if self.by_word:
            return self.cache.ids([self.words(t) for t in filled])
        got = [e.ids for e in self.tokenizer.encode_batch_fast(filled, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, got)])
        return np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(ends[-1])), ends

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that the leading marker stands for."""
        table = self.bytes
        out = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def verify(self, data: bytes, texts: list[str]) -> None:
        """Fails unless ids and decoded texts are those of the sentencepiece library."""
        import sentencepiece

        judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids, at = self.encode(texts)
        for k, text in enumerate(texts):
            own = ids[at[k] : at[k + 1]].tolist()
            if own != judge.encode(text):
                raise AssertionError(f"ids differ for {text[:80]!r}")
            if self.decode(own) != judge.decode(own):
                raise AssertionError(f"decoded text differs for {text[:80]!r}")


#: Texts on which every built codec is verified.
PROBES = ["", " ", "a", "  two  spaces ", "plain words, and 123 numbers.", "Zürich naïve ¿qué? façade", "日本語 テキスト", "tab\tline\nend\r\n", "🙂 emoji 👩‍👩‍👧", "<s> </s> <unk> <0x0A>", "x" * 300, "▁marked ▁▁", "é ﬁ Ⅳ", " nbsp　wide"]


@lru_cache(maxsize=2)
def codec(data: bytes, threads: int = 2) -> Codec:
    """One per worker process, verified when built."""
    made = Codec(data, threads)
    made.verify(data, PROBES)
    return made


def coded(docs: DataFrame, model_file: bytes, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text again), ids."""
    data = docs.sparkSession.sparkContext.broadcast(model_file)

    def run(x: dict[str, list]) -> dict:
        c = codec(data.value, threads)
        every, at = c.encode(x["text"])
        own = [every[a:b] for a, b in zip(at[:-1], at[1:])]
        out = {
            "doc_id": x["doc_id"],
            "n_tokens": np.diff(at),
            "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in own],
            "round_trip": [c.decode(i.tolist()) == (t or "") for i, t in zip(own, x["text"])],
        }
        return out | ({"ids": [i.astype(np.int32) for i in own]} if with_ids else {})

    return common.text_map(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def decoded(tokens: DataFrame, model_file: bytes) -> DataFrame:
    """doc_id, text of every row of tokens (doc_id, ids); null ids are the empty text, an id beyond the model is unknown."""
    data = tokens.sparkSession.sparkContext.broadcast(model_file)

    def run(x: dict[str, list]) -> dict:
        c = codec(data.value)
        known, unknown = range(len(c.bytes)), c.model.unknown
        return {"doc_id": x["doc_id"], "text": [c.decode([i if i in known else unknown for i in ids or ()]) for ids in x["ids"]]}

    return common.text_map(tokens, ["doc_id", "ids"], run, "doc_id long, text string")
