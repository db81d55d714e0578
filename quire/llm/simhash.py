"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits; a bit is 1 if over half of its shingles' XXH64 values have it. Fingerprints link at
``most`` differing bits or fewer. The bits stand in ``segments`` segments on a ring: if the whole ring differs in at
most t bits, then from some start every chain of l consecutive segments differs in at most l*t/m bits. The longest
chain with a budget below one bit must be equal, so it is the key of an index (for t=2, m=5 two segments, 26 bits);
the budgets of longer chains prune what shares a key before the full Hamming check.

A key shared by few fingerprints is settled pair by pair. Under a key shared by more than ``pairwise`` fingerprints the
other bits, which may differ in two at most, are cut in three parts, of which one must be equal: with the key it makes a
second key of about 38 bits, so chance meetings stay few up to some 10^13 fingerprints. What crowds a second key, too, is
a true cluster, and is settled in time linear in its number: two fingerprints are within two bits of each other if and
only if some 64-bit value is within one bit of both, so each is put under the values within one bit of it. No group is
ever expanded into all pairs, and no link is lost.

Links are found between distinct fingerprints; equal ones form a class first, by a partial aggregate.

``wide`` makes longer fingerprints of any set of hashes and ``differing`` counts their bits, for stages that link at a
likeness which 64 bits cannot tell.

Defined results: null text is empty; a text without words has fingerprint zero, linked like any other; fewer words than
a shingle make one shingle of them all; equal and repeated rows have one class; a row with a null id links like any
other and gets the smallest id that it can reach (null if it reaches none); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.graph import components
from quire.llm.minhash import mix

SEED = 42


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words of the text (A-Z lowered, joined by spaces), repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip([0, *(x + 1 for x in ends[: n - width])], ends[width - 1 :])]


def fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """One uint64 per text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    shift = np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = np.array(shingle_hashes(text, width), dtype=np.uint64)
        if len(h):
            counts = np.zeros(64, dtype=np.int64)
            for k in range(0, len(h), 65_536):  # bounded memory for texts of any length
                bits = np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            out[i] = ((counts * 2 > len(h)).astype(np.uint64) << shift).sum(dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as the signed long of its 64 bits."""

    def run(x: dict[str, list]) -> dict:
        return {"doc_id": x[id_col], "fp": fingerprints(x[text_col], width).view(np.int64)}

    return common.text_map(docs, [id_col, text_col], run, "doc_id long, fp long")


def masks(segments: int) -> list[int]:
    """Bits of each segment, as equal as can be."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(a: Column, b: Column, start: int, segments: int, most: int) -> Column:
    """All chains from the start keep to their budgets; the last chain is the full Hamming check."""
    parts, ok, mask = masks(segments), None, 0
    for length in range(1, segments + 1):
        mask |= parts[(start + length - 1) % segments]
        own = F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(mask)))) <= length * most // segments
        ok = own if ok is None else ok & own
    return ok


def links(classes: DataFrame, most: int = 2, segments: int = 5, pairwise: int = 64) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of classes (fp) whose link graph has the right components.

    Every linked pair is an edge or is joined by edges through fingerprints linked to both.
    """
    if most != 2 or segments < 3:
        raise ValueError("the linear way for crowded keys is exact for links of two bits")
    parts, equal = masks(segments), (segments + most - 1) // most - 1
    keyed, second = [], []
    for i in range(segments):
        mask = sum(parts[(i + k) % segments] for k in range(equal))
        keyed.append(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")))
        rest = [b for b in range(64) if not mask >> b & 1]
        cuts = [sum(1 << b for b in rest[len(rest) * k // 3 : len(rest) * (k + 1) // 3]) for k in range(3)]
        second.append(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(c))).alias("bits")) for k, c in enumerate(cuts))))
    keys = classes.select("fp", F.explode(F.array(*keyed)).alias("k")).select("fp", "k.i", "k.key")
    shared = common.checkpointed(_met(keys, ["i", "key"]))
    few, many = shared.where(F.col("n") <= pairwise), shared.where(F.col("n") > pairwise)
    chain = F.lit(False)
    for i in range(segments):
        chain = chain | ((F.col("a.i") == i) & _within(F.col("a.fp"), F.col("b.fp"), i, segments, most))
    near = _pairs(few, ["i", "key"], chain)
    by = F.col("i")
    cut = F.explode(F.coalesce(*(F.when(by == i, x) for i, x in enumerate(second))))
    finer = many.drop("n").withColumn("k", cut).select("fp", "i", "key", "k.part", "k.bits")
    finer = _met(finer, ["i", "key", "part", "bits"])
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most
    near = near.union(_pairs(finer.where(F.col("n") <= pairwise), ["i", "key", "part", "bits"], close))
    # Clusters: under each value within one bit, at most 65 distinct fingerprints meet.
    cluster = finer.where(F.col("n") > pairwise).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    met = cluster.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("of")).where(F.size("of") > 1)
    met = met.select(F.array_min("of").alias("v"), F.explode("of").alias("u")).where("u <> v")
    return near.union(met.select("u", "v")).distinct()


def _met(keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key others have, too, with the number of them."""
    return keys.join(keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), by)


def _pairs(keys: DataFrame, by: list[str], close: Column) -> DataFrame:
    a, b = keys.alias("a"), keys.alias("b")
    same = (F.col("a.fp") < F.col("b.fp")) & close
    for c in by:
        same = (F.col(f"a.{c}") == F.col(f"b.{c}")) & same
    return a.join(b, same).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))


def classes_of(prints: DataFrame, most: int = 2, segments: int = 5, pairwise: int = 64) -> DataFrame:
    """(fp, component) of each distinct fingerprint of prints (doc_id, fp): the least id that it can reach."""
    classes = common.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes.select("fp"), most, segments, pairwise)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = common.checkpointed(classes.join(found, "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root")))
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("fp", "component")


def grouped(docs: DataFrame, width: int = 3, most: int = 2, segments: int = 5, pairwise: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    prints = common.checkpointed(fingerprinted(docs, width))
    out = prints.join(classes_of(prints, most, segments, pairwise), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def wide(sets: list[np.ndarray], words: int) -> np.ndarray:
    """(sets x words) uint64: fingerprints of 64 x ``words`` bits of sets of 64-bit hashes."""
    out = np.zeros((len(sets), words), dtype=np.uint64)
    shift = np.arange(64, dtype=np.uint64)
    for i, h in enumerate(sets):
        for w in range(words):
            counts = np.zeros(64, dtype=np.int64)
            for k in range(0, len(h), 65_536):
                part = mix(h[k : k + 65_536] ^ mix(np.array([w], dtype=np.uint64)))
                counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i, w] = ((counts * 2 > len(h)).astype(np.uint64) << shift).sum(dtype=np.uint64)
    return out


def differing(a: Column, b: Column, words: int) -> Column:
    """The number of differing bits of two arrays of ``words`` longs."""
    return sum((F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))) for w in range(1, words)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
