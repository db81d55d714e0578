"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every shingle (five words, A-Z lowered; fewer words make one shingle of them all) is hashed once. The hash's first bits
name one of ``bins`` bins, which keeps its smallest value. An empty bin takes the value of the first filled bin in an
order of its own, fixed by a seeded permutation per bin (so a donor is a uniform choice and the same for all texts),
hashed with the bin's number.
Two low bits of each bin are kept; the share of equal bins, freed from the agreement of chance (1/4), estimates the
Jaccard likeness.

The comparison with the next document sends each text once: documents are dealt into blocks of consecutive ids, the
first of each block also to the block before it.

Defined results: null text counts as empty; a text without words has the fingerprint ``00`` and likeness 1 to another
such text, else 0; equal texts have equal fingerprints; null ids stand before all others, equal ids in order of their
texts' hashes; texts of any length are hashed whole, in pieces;
the only document of a table is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

BINS, BITS, WIDTH = 1024, 2, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables():
    kind = np.zeros(256, dtype=np.uint64)  # 0: white space, else 1 + the lowered byte
    for b in range(256):
        kind[b] = 0 if b in (9, 10, 11, 12, 13, 32) else 1 + (b + 32 if 65 <= b <= 90 else b)
    return kind


@lru_cache(maxsize=1)
def _powers(n: int):
    """_ODD^i and its inverses modulo 2^64, i < n."""
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _ODD, dtype=np.uint64))
        down = np.cumprod(np.full(n, inverse, dtype=np.uint64))
    return up, down


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the number of the text of each."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    value = _tables()[data]
    inside = np.concatenate([[False], value > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    size = max(1 << 20, 1 << int(len(data) + 1).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * up[: len(value)])])
        words = mix((sums[end] - sums[start]) * down[start])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    of = np.searchsorted(np.cumsum(lengths), start, side="right")
    count = np.bincount(of, minlength=len(texts))
    pad = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[of]
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), dtype=np.uint64)
        factor = 1
        for k in range(width):
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
            there = place + k < count[of]
            total += np.where(there, pad[k : k + len(words)], np.uint64(k)) * np.uint64(factor)
    whole = (place + width <= count[of]) | (place == 0)
    return mix(total[whole]), of[whole]


@lru_cache(maxsize=1)
def _orders(bins: int) -> np.ndarray:
    """orders[t, j]: the bin that empty bin j tries at its t-th attempt."""
    rng = np.random.Generator(np.random.PCG64(20_240_601))
    return np.argsort(rng.random((bins, bins)), axis=1).T.astype(np.int16).copy()


def pieces(text: bytes, width: int, size: int = 1 << 18) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes whose shingles are together those of the text: each further piece begins
    with the last width - 1 words of the one before."""
    start, n, step = 0, len(text), size
    while n - start > step:
        gap = _GAP.search(text, start + step)
        if not gap or not _WORD.search(text, gap.end()):
            break  # no word after this piece
        part = text[start : gap.start()]
        words = part.rsplit(None, width - 1)
        if len(words) < width:
            step *= 2  # words so long that the piece has too few of them
            continue
        yield part
        start, step = start + len(words[0]), size
    yield text[start:]


_GAP, _WORD = re.compile(rb"[\x20\x09-\x0D]+"), re.compile(rb"[^\x20\x09-\x0D]")


def piecewise(texts: list[bytes], width: int = WIDTH, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``shingles`` of the texts, in runs of bounded size however long a text is."""
    run, owner, held = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text, width, size) if len(text) > size else (text,):
            if held and held + len(part) > 2 * size:
                h, of = shingles(run, width)
                yield h, np.array(owner)[of]
                run, owner, held = [], [], 0
            run.append(part)
            owner.append(i)
            held += len(part)
    if run:
        h, of = shingles(run, width)
        yield h, np.array(owner)[of]


def sketch(texts: list[bytes], bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins) low-order bits, and which texts have a shingle."""
    low = np.zeros((len(texts), bins), dtype=np.uint8)
    any_word = np.zeros(len(texts), dtype=bool)
    orders = _orders(bins)
    shift = np.uint64(64 - bins.bit_length() + 1)
    for k in range(0, len(texts), 4096):
        part = texts[k : k + 4096]
        full = np.zeros(len(part) * bins, dtype=bool)
        value = np.full(len(part) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        for h, of in piecewise(part, width):
            slot = of * bins + (h >> shift).astype(np.int64)
            # Slot and the hash's next bits in one number: a stable sort by it finds each slot's least.
            order = np.argsort((slot.astype(np.uint64) << np.uint64(42)) | ((h << np.uint64(64 - int(shift))) >> np.uint64(22)), kind="stable")
            slot, h = slot[order], h[order]
            head = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, dtype=bool)
            full[slot[head]] = True
            value[slot[head]] = np.minimum(value[slot[head]], h[head])
        filled = full.reshape(-1, bins).any(1)
        empty = np.flatnonzero(~full & np.repeat(filled, bins))
        row, col = empty // bins * bins, empty % bins
        for t in range(bins):
            if not len(empty):
                break
            donor = row + orders[t, col]
            hit = full[donor]
            # Bits of the donor's value and the bin's number: two texts of few shingles agree by chance in each bin anew.
            value[empty[hit]] = mix(value[donor[hit]] ^ mix(col[hit].astype(np.uint64)))
            empty, row, col = empty[~hit], row[~hit], col[~hit]
        value[np.repeat(~filled, bins)] = 0
        low[k : k + len(part)] = (value & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(-1, bins)
        any_word[k : k + len(part)] = filled
    return low, any_word


def packed_hex(low: np.ndarray, any_word: np.ndarray, bits: int = BITS) -> list[str]:
    """``01`` and the bins' bits as hex digits; ``00`` for a text without words."""
    planes = np.unpackbits(low[..., None], axis=2, bitorder="little", count=bits).reshape(len(low), -1)
    data = np.packbits(planes, axis=1, bitorder="little")
    return ["01" + row.tobytes().hex() if some else "00" for row, some in zip(data, any_word)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of rows, corrected for bins that agree by chance."""
    chance = 2.0**-bits
    got = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, got, np.where(some_a == some_b, 1.0, 0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(x: dict[str, list]) -> dict:
        return {"doc_id": x["doc_id"], "fingerprint": packed_hex(*sketch([(t or "").encode("utf-8", "replace") for t in x["text"]]))}

    return common.text_map(docs, ["doc_id", "text"], run, "doc_id long, fingerprint string")


def _at_most(key: Column, splits: list[int], fan: int = 64) -> Column:
    """How many of the sorted splits are at most key, found in steps of at most ``fan`` comparisons each."""
    text = lambda xs: "array(" + ",".join(f"CAST('{x}' AS BIGINT)" for x in xs) + ")"
    if not splits:
        return F.lit(0)
    if len(splits) <= fan:
        return F.size(F.filter(F.expr(text(splits)), lambda x: x <= key))
    rows = [splits[i : i + fan] for i in range(0, len(splits), fan)]
    row = F.greatest(_at_most(key, [r[0] for r in rows], fan) - 1, F.lit(0))
    nested = F.expr("array(" + ",".join(text(r) for r in rows) + ")")
    return row * fan + F.size(F.filter(F.get(nested, row), lambda x: x <= key))


def _blocks(keyed: DataFrame, blocks: int) -> DataFrame:
    """keyed (key, digest, ...) with ``block``: about ``blocks`` runs of rows in order of key and digest.

    A key that many rows share (rows without an id, say) fills blocks of its own, cut by the texts' hashes.
    """
    if blocks < 2:
        return keyed.withColumn("block", F.lit(0))
    cuts = keyed.agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] or []
    crowd = {k: cuts.count(k) + 1 for k in {a for a, b in zip(cuts, cuts[1:]) if a == b}}
    splits = sorted({*cuts, *(k + 1 for k in crowd if k < (1 << 63) - 1)})
    place = _at_most(F.col("key"), splits).cast("long")
    if not crowd:
        return keyed.withColumn("block", place.cast("int"))
    # Blocks of a crowded key: its share of the digests' range, numbered behind one another.
    many = keyed.sparkSession.createDataFrame(list(crowd.items()), "key long, parts int")  # under blocks / 2 rows
    extra = [0]
    for k in sorted(crowd):
        extra.append(extra[-1] + crowd[k] - 1)
    below = _at_most(F.col("key"), sorted(crowd)) - F.col("parts").isNotNull().cast("int")
    added = F.get(F.expr("array(" + ",".join(map(str, extra)) + ")"), below)
    signed = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))  # order of signed longs
    share = F.floor((F.shiftrightunsigned(signed, 33) * F.col("parts")) / F.lit(1 << 31))
    out = keyed.join(F.broadcast(many), "key", "left")
    return out.withColumn("block", (place + added + F.coalesce(share, F.lit(0))).cast("int")).drop("parts")


def edited(docs: DataFrame, rows_per_block: int = 8192, max_blocks: int = 65_536) -> DataFrame:
    """Each document against its text with the last quarter replaced by the next document's beginning, and against that document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", body.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64(body).alias("digest"))
    rows = keyed.count()
    keyed = _blocks(keyed, min(max_blocks, max(1, -(-rows // rows_per_block))))
    # Blocks number at most twice max_blocks; the first row of each is lent to the block before it.
    firsts = keyed.groupBy("block").agg(F.min(F.struct("key", "digest")).alias("first")).select("block", "first.*").orderBy("block").collect()
    lenders = [(r.key, r.digest, firsts[i - 1].block) for i, r in enumerate(firsts)]  # the first of all follows the last of all
    small = spark.createDataFrame(lenders, "key long, digest long, lender int")
    copies = keyed.join(F.broadcast(small), ["key", "digest"]).withColumn("block", F.col("lender")).drop("lender")
    both = keyed.withColumn("tail", F.lit(False)).unionByName(copies.withColumn("tail", F.lit(True)))
    dealt = both.repartitionById(firsts[-1].block + 1 if firsts else 1, F.col("block")).sortWithinPartitions("block", "tail", "key", "digest")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compared(ids: list, texts: list[str], low: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        """Rows for all but the last of consecutive documents."""
        changed = []
        for t, after in zip(texts[:-1], texts[1:]):
            k = len(t) // 4
            changed.append((t[: len(t) - k] + after[:k]).encode("utf-8", "replace"))
        elow, esome = sketch(changed)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], type=pa.int64()), pa.array([len(t) for t in texts[:-1]], type=pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], type=pa.string()),
            pa.array(packed_hex(low[:-1], some[:-1]), type=pa.string()), pa.array(packed_hex(elow, esome), type=pa.string()),
            pa.array(likeness(low[:-1], elow, some[:-1], esome)), pa.array(likeness(low[:-1], low[1:], some[:-1], some[1:])),
        ], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block = None  # the last document of the block so far: id, text, sketch, has words
        for batch in batches:
            for part in common.slices(batch):
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4))))
                at = 0
                while at < len(rows):
                    end = at + 1
                    while end < len(rows) and rows[end][2] == rows[at][2] and not rows[end - 1][3]:
                        end += 1
                    run_of, now = rows[at:end], rows[at][2]
                    at = end
                    if held is None and run_of[0][3]:
                        continue  # a further copy of the tail: the block is done
                    low, some = sketch([r[1].encode("utf-8", "replace") for r in run_of])
                    ids, texts = [r[0] for r in run_of], [r[1] for r in run_of]
                    if held is not None and block == now:
                        ids, texts = [held[0], *ids], [held[1], *texts]
                        low, some = np.vstack([held[2], low]), np.concatenate([held[3], some])
                    if len(ids) > 1:
                        yield compared(ids, texts, low, some)
                    held, block = (ids[-1], texts[-1], low[-1:], some[-1:]), now
                    if run_of[-1][3]:
                        held = None

    return dealt.select("doc_id", "text", "block", "tail").mapInArrow(run, schema)
