"""Near copies: word shingles of five words with a Jaccard likeness of 0.8 or more, checked exactly.

Each text has a SimHash of 64 bits over its shingles, and the pigeonring index of ``simhash.links`` finds what differs in
two bits or fewer: the texts of one class of it are candidates of each other. Links at a likeness of 0.8 differ in some 15 %
of a SimHash's bits (27 degrees), so of 64 in 10 or more: a pigeonring index for these would have to take segments of four
bits as keys, which is no index. Beside the class, a text therefore has 21 keys, six of the 128 bins of a one-permutation
MinHash, eight bits each. A pair of likeness 0.8 shares a key with a chance of 0.998, one of 0.9 all but always. SimHash
prunes all candidates: of 256 bits over the same shingles at most ``MOST`` may differ (four standard deviations beyond the
mean at 0.8; small sets, whose bits are too few votes, are not pruned), before the shingle sets are compared.

Every candidate pair that can change a group is checked: first each text with one text of each of its keys, then with a
second one that the first left apart, then, under keys whose texts are still in several groups, each pair of different
groups, once. Pairs that are not near copies never leave the join. No key is capped or sampled; the last step's time is
quadratic only in texts that share a key and are near copies of neither of the two.

Texts with equal shingle sets form a class first, by a 64-bit digest of the set.

Defined results: null text is empty; texts without words form one class; fewer words than a shingle make one shingle of
them all; rows that repeat an id are rows like any other, and stay unless near copies; of the rows of a group that with the least
id stays (without ids: the least hash of the text), of its repeated copies one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common, minhash, simhash
from quire.llm.graph import components

WIDTH, LEAST = 5, 0.8
BINS, BITS, ROWS = 128, 8, 6
KEYS = BINS // ROWS
#: SimHash: longs, most differing bits, shingles under which sets are not pruned.
WORDS, MOST, SMALL = 4, 62, 32


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)), *minhash.piecewise([(t or "").encode("utf-8", "replace") for t in texts], width)]
    h, of = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, of = h[first], of[first]
    return np.split(h, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def digests(sets: list[np.ndarray]) -> list[int]:
    """A signed long for each set, zero for the empty one."""
    with np.errstate(over="ignore"):
        return [int(minhash.mix(minhash.mix(s).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) if len(s) else 0 for s in sets]


def keyed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, node, fp, keys): the text's hash, the digest of its shingle set, the set's SimHash of 64 bits and its
    keys, none for a text without words."""

    def run(x: dict[str, list]) -> dict:
        low, some = minhash.sketch([(t or "").encode("utf-8", "replace") for t in x["text"]], BINS, BITS, width)
        bands = np.zeros((len(low), KEYS, 8), dtype=np.uint8)
        bands[:, :, :ROWS] = low[:, : KEYS * ROWS].reshape(-1, KEYS, ROWS)
        bands[:, :, 7] = np.arange(KEYS)  # keys of different bins differ
        keys = bands.view(np.int64)[:, :, 0]
        sets = shingle_sets(x["text"], width)
        fp = simhash.wide(sets, 1).view(np.int64)[:, 0]
        return {"doc_id": x["doc_id"], "digest": x["digest"], "node": digests(sets), "fp": fp, "keys": [k if ok else [] for k, ok in zip(keys, some)]}

    some = docs.select("doc_id", "text").withColumn("digest", text_digest())
    return common.text_map(some, ["doc_id", "digest", "text"], run, "doc_id long, digest long, node long, fp long, keys array<long>")


def text_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, prints: DataFrame, nodes: DataFrame, repeated: bool, width: int = WIDTH) -> DataFrame:
    """(node, size, bits, shingles) of the nodes, read from one row of each."""

    def run(x: dict[str, list]) -> dict:
        sets = shingle_sets(x["text"], width)
        return {"node": digests(sets), "size": [len(s) for s in sets], "bits": list(simhash.wide(sets, WORDS).view(np.int64)), "shingles": [s.view(np.int64) for s in sets]}

    one = prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("row"))
    one = common.small(common.checkpointed(one.select(F.col("row.doc_id").alias("__id"), F.col("row.digest").alias("__digest"))))
    some = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_digest() == F.col("__digest")), "left_semi")
    sets = common.text_map(some, ["text"], run, "node long, size int, bits array<long>, shingles array<long>")
    return sets.dropDuplicates(["node"]) if repeated else sets


def may_be(a: str, b: str, least: float) -> Column:
    """Whether the sets of the rows named a and b can be near copies by their sizes and SimHashes."""
    few, more = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (few >= least * more) & ((few < SMALL) | (simhash.differing(F.col(f"{a}.bits"), F.col(f"{b}.bits"), WORDS) <= MOST))


def are(a: str, b: str, least: float) -> Column:
    """Whether they are, by the shingles."""
    both = F.size(F.array_intersect(f"{a}.shingles", f"{b}.shingles"))
    return both >= least * (F.col(f"{a}.size") + F.col(f"{b}.size") - both)


def starred(told: DataFrame, hub: Column, sets: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of the nodes of told (key, node, c) to one node of each of their keys, which ``hub`` picks from the group."""
    hubs = told.groupBy("key").agg(hub.alias("v"))
    pairs = told.join(hubs.where("v.node IS NOT NULL"), "key").where("c <> v.c").select(F.col("node").alias("u"), F.col("v.node").alias("v")).distinct()
    for columns, test in ((("size", "bits"), may_be), (("size", "shingles"), are)):  # shingles travel for pairs that the bits leave
        a, b = sets.select(F.col("node").alias("u"), *columns), sets.select(F.col("node").alias("v"), *columns)
        if test is are:
            pairs = common.checkpointed(pairs)
            ends = pairs.select("u").union(pairs.select("v")).distinct()
            a, b = a.join(ends, "u", "left_semi"), b.join(ends.withColumnRenamed("u", "v"), "v", "left_semi")
        pairs = pairs.join(a, "u").alias("a").join(b.alias("b"), "v").where(test("a", "b", least)).select("u", "v")
    return pairs


def classed(nodes: DataFrame) -> DataFrame:
    """(node, keys): the class of a node's SimHash in the pigeonring index is a key more (its last byte tells it from the others)."""
    prints = common.checkpointed(nodes.where(F.size("keys") > 0).select("fp").distinct())
    found = common.checkpointed(components(simhash.links(prints)).select(F.col("node").alias("fp"), F.col("component").alias("root")))
    key = F.coalesce("root", "fp").bitwiseAND(F.lit((1 << 56) - 1)).bitwiseOR(F.lit(KEYS << 56))
    keys = F.when(F.size("keys") > 0, F.array_append("keys", key)).otherwise(F.col("keys"))
    return nodes.join(common.small(found), "fp", "left").select("node", keys.alias("keys"))


def groups_of(docs: DataFrame, prints: DataFrame, repeated: bool, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """(node, component) of the nodes of prints that have a near copy."""
    nodes = classed(prints.select("node", "fp", "keys").dropDuplicates(["node"]))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    crowd = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = common.checkpointed(keys.join(crowd, "key", "left_semi"))
    sets = common.checkpointed(sets_of(docs, prints, shared.select("node").distinct(), repeated, width))
    this = F.struct("node", "c")
    near = common.checkpointed(starred(shared.withColumn("c", F.col("node")), F.min(this), sets, least))
    common.release(docs.sparkSession)
    # A second text of each key: the last of those that are not linked to its least.
    heads = near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("head"))
    told = common.checkpointed(shared.join(heads, "node", "left").select("key", "node", F.least("node", F.coalesce("head", "node")).alias("c")))
    far = told.join(told.groupBy("key").agg(F.min(this).alias("first")), "key")
    again = starred(far, F.max(F.when(F.col("c") != F.col("first.c"), this)), sets, least)
    near = common.checkpointed(near.union(again))
    del heads, far, again, told
    common.release(docs.sparkSession)
    told = _told(shared, near)
    apart = told.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    left = told.join(apart, "key", "left_semi").join(nodes, "node").join(sets, "node")
    # The pair is looked at under its first common key alone.
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & may_be("a", "b", least) & once & are("a", "b", least)
    return components(near.union(left.alias("a").join(left.alias("b"), met).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))))


def _told(shared: DataFrame, near: DataFrame) -> DataFrame:
    """(key, node, c): what shares keys and its component so far."""
    return common.checkpointed(shared.join(components(near), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))


def one_of_each(docs: DataFrame, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """docs without the rows whose group holds one of a smaller id; every column as it is."""
    prints = common.checkpointed(keyed(docs, width))
    repeated = bool(prints.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count())
    found = prints.select("doc_id", "digest", "node").join(groups_of(docs, prints, repeated, least, width), "node", "left")
    found = common.checkpointed(found.select("doc_id", "digest", F.coalesce("component", "node").alias("component")))
    common.release(docs.sparkSession)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("digest"))
    # Only groups of several rows lose any; broadcast behind a count, they meet a large group's rows where these are.
    first = found.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = common.small(common.checkpointed(first))
    gone = found.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))))
    gone = common.small(common.checkpointed(gone.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()))
    names = [f"c{i}" for i in range(len(docs.columns))]  # by position: columns may clash with those used here
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col("doc_id").alias("__own"), text_digest().alias("__text"))
    kept = own.join(gone, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_anti")
    if repeated:  # one of each stays
        kept = kept.dropDuplicates(["__own", "__text"])
    return kept.select(*names).toDF(*docs.columns)
