"""Token counts by a tokenizer's file, for packing."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Counts of words that a worker keeps, the longest word whose count is kept, and bytes of text that it handles at once.
KEPT, LONGEST, AT_ONCE = 500_000, 64, 8_000_000
#: White space at which words are counted apart, normalisers that work within words, and ways to cut that part words.
SPACE = " \t\n\r\v\f"
WITHIN = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")
PARTING = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words by which the shorter way to count plain words is verified.
PROBES = ["a", "Plain", "words,", "LOUD!!!", "so...", "don'", "end.\"", "(", "]]", "x_", "y-", "z'", "Q" * 300, "the" * 40 + "?" * 70, "endoftext|>", "Élève", "ÇaÖß.", "naïvetés,", *(f"Ab{m}{n}" for m in string.punctuation for n in string.punctuation)]


def by_words(spec: str) -> bool:
    """Whether the tokens of a text are those of its words: white space parts them and makes none."""
    told = json.loads(spec)
    each = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    blanks = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    cut = each(told["pre_tokenizer"], "pretokenizers")[:1]
    parts = cut and (cut[0]["type"] in PARTING or (cut[0]["type"] == "Split" and cut[0]["pattern"] == {"Regex": CLIP} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]))
    plain = all(x["type"] in WITHIN or blanks(x) for x in each(told["normalizer"], "normalizers"))
    return bool(parts and plain and not any(c in SPACE for t in told["added_tokens"] for c in t["content"]))


class Counter:
    """Counts of texts' tokens. Those of words are kept and added up, if the tokenizer parts words; else texts are encoded whole.

    A new word of Latin letters, each of which the tokenizer hands to its model as one piece of its own (lowered or spelt in
    bytes), and of marks after them that it parts from letters, is counted by the model alone, letters and marks apart; if any
    probe has another count so, no word is.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_str(spec)
        self.made.no_truncation()
        self.made.no_padding()
        self.model = self.made.model
        self.parted = by_words(spec)
        self.known: dict[str, int] = {"": 0}
        self.stems: dict[str, int] = {}
        self.plain = self._plain() if self.parted else re.compile("(?!)")
        if self.parted and self._new(PROBES) != self.whole(PROBES):
            self.plain = re.compile("(?!)")
        self.stems.clear()

    def _plain(self) -> re.Pattern:
        apart = self._apart
        marks = "".join(c for c in string.punctuation if apart("a" + c + c) == [*apart("a"), *apart(c + c)])
        told = {c: apart(c) for c in map(chr, range(0x250)) if c.isalpha()}
        self.spelt = {ord(c): p[0] for c, p in told.items() if len(p) == 1 and apart(c + marks) == [*p, *apart(marks)]}
        letters, end = "".join(map(chr, self.spelt)), f"[{re.escape(marks)}]*" if marks else ""
        added = any(re.fullmatch(f"[{letters}]*{end}", t.content) for t in self.made.get_added_tokens_decoder().values()) if letters else True
        if added or apart(letters) != [letters.translate(self.spelt)]:
            return re.compile("(?!)")
        return re.compile(f"([{letters}]+)({end})")

    def _apart(self, text: str) -> list[str]:
        """The pieces that the model gets."""
        text = self.made.normalizer.normalize_str(text) if self.made.normalizer else text
        return [p for p, _ in self.made.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[int]:
        """Counts of distinct words that are not known."""
        cut = [self.plain.fullmatch(w) for w in words]
        odd = [w for w, m in zip(words, cut) if not m] + list({m[2] for m in cut if m and m[2]})
        here = dict(zip(odd, self.whole(odd)))
        stems, tokens = self.stems, self.model.tokenize

        def stem(w: str) -> int:
            n = stems.get(w)
            if n is None:
                n = len(tokens(w))
                if len(stems) < KEPT and len(w) <= LONGEST:
                    stems[w] = n
            return n

        return [(stem(m[1].translate(self.spelt)) + (here[m[2]] if m[2] else 0)) if m else here[w] for w, m in zip(words, cut)]

    def _sizes(self, words: list[str]) -> np.ndarray:
        """Counts of distinct words."""
        known = self.known
        sizes = [known.get(w) for w in words]
        new = [w for w, n in zip(words, sizes) if n is None]
        if new:
            here = dict(zip(new, self._new(new)))
            sizes = [here[w] if n is None else n for w, n in zip(words, sizes)]
            if len(known) < KEPT:
                known.update((w, n) for w, n in here.items() if len(w) <= LONGEST)
        return np.array(sizes, dtype=np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Counts of an Arrow array of texts (null: 0)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.parted:
            return np.array(self.whole(texts.to_pylist()), dtype=np.int64)
        out, step = [np.zeros(0, dtype=np.int64)], max(1, len(texts) * AT_ONCE // max(1, texts.nbytes))
        for i in range(0, len(texts), step):
            words = pc.ascii_split_whitespace(texts.slice(i, step))
            at = words.offsets.to_numpy() - words.offsets[0].as_py()
            told = words.flatten().dictionary_encode()
            sizes = self._sizes(told.dictionary.to_pylist())[told.indices.to_numpy()]
            out.append(np.diff(np.concatenate([[0], np.cumsum(sizes)])[at]))
        return np.concatenate(out)

    def __call__(self, texts: list[str]) -> list[int]:
        return self.counts(pa.array(texts, pa.large_string())).tolist()


@lru_cache(maxsize=2)
def _counter(spec: str) -> Counter:
    return Counter(spec)


def counts_of(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function of a text column: how many tokens the tokenizer of a ``tokenizers`` file, read by the driver, makes of it.
    Its ``adds`` tells whether counts of texts that white space joins add up."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = spark.sparkContext.broadcast(text)

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(spec.value).counts(texts).astype(np.int32))

    run.adds = by_words(text)
    return run
