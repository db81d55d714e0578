"""Whitening and decontamination beside plain versions of them."""

import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import decontamination, whitening
from quire.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, component int, y string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "y", 5) for i, v in rows], VECTORS)


def plain_whitening(rows, k=16):
    """Rows (vec_id, x), each vector in the fit list once."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array(fit * n - sums, dtype=np.float64) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    out = {}
    for i, x in rows:
        off = np.array(x, dtype=object) * n - sums
        out.setdefault(i, []).append((int((off * off).sum()), np.array(off / n, dtype=np.float64) @ basis / np.sqrt(values)))
    return n, values / np.trace(cov), out


def test_whitening_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    n, explained, want = plain_whitening([(r.vec_id, [int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding]) for r in table])
    got = QUERIES["op11_whitening"](spark, d).collect()
    assert len(got) == 16 * len(table) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    sign = {}
    for r in got:
        deviation, row = want[r.vec_id][0]
        assert r.deviation == deviation and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        w = row[r.component - 1]
        if r.component not in sign and abs(w) > 0.1:
            sign[r.component] = np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-7
    assert len(sign) == 16
    assert all(abs(want[r.vec_id][0][1][r.component - 1] * sign[r.component] - r.whitened) < 1e-7 for r in got)


def test_whitening_leaves_out_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, rows[0][1]), (3, rows[7][1])]
    got = whitening.whitened(vectors(spark, [*rows, *odd, rows[5], rows[5]]).repartition(7)).collect()
    assert {r.n for r in got} == {40} and {r.component for r in got} == {1, 2, 3}
    count = {i: sum(r.vec_id == i for r in got) for i in (100, 101, 102, 103, 104, 105, None, 3, 5)}
    assert count == {100: 0, 101: 0, 102: 0, 103: 0, 104: 0, 105: 0, None: 3, 3: 6, 5: 9}
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-12
    assert whitening.whitened(vectors(spark, odd[:5])).count() == 0
    assert whitening.whitened(vectors(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_without_variance_and_of_large_entries(spark):
    flat = whitening.whitened(vectors(spark, [(i, [0.5, 0.25]) for i in range(9)])).collect()
    assert len(flat) == 18 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in flat)
    line = whitening.whitened(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and max(r.identity_error for r in line) < 1e-9
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 7.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id != 3) and all(r.whitened is not None for r in huge if r.component == 1)


def test_merging_is_the_same_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, size=(500, 6))
    whole = whitening.moments(x)
    parts = [whitening.moments(p) for p in np.split(x, [3, 50, 51, 400])]
    while len(parts) > 1:
        a, b = parts.pop(int(rng.integers(len(parts)))), parts.pop(0)
        parts.append(a.merged(b))
    assert parts[0].sums == whole.sums and parts[0].n == 500 and np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12)
    big = whitening.moments(np.full((4, 2), 1 << 62))
    assert big.sums == [1 << 64, 1 << 64]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_marks(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed=3):
    rng = random.Random(seed)
    some = ["a", "bb", "ccc", "Dé", "x9", "日本", "longerwordthaneight", "longerwordthaneighu", "e"]
    say = lambda n: "".join(rng.choice(some) + rng.choice([" ", "  ", "-", "\n", ". "]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 3, 9, 10, 11, 30, 60]))) for i in range(60)]
    items += [(7, items[20][1]), (8, None), (9, "---"), (None, say(12)), (61, items[5][1].upper()), *items[:3]]
    docs = [(i, say(rng.choice([0, 1, 5, 9, 10, 40, 200]))) for i in range(80)]
    docs += [(200 + i, f"{say(4)} {t} {say(3)}") for i, (_, t) in enumerate(items)]
    docs += [(5, docs[5][1]), (None, docs[100][1]), (None, None), (300, ""), (301, " ".join(docs[k][1] for k in range(80, 140)))]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 3, "d", 1, []) for i, t in docs], "doc_id long, text string, n_words int, digest string, item long, spans array<int>"),
        spark.createDataFrame([(i, t, "p") for i, t in items], "item_id long, text string, piece string"),
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_marks_against_all_windows(spark, block):
    docs, items = case()
    d, i = frames(spark, docs, items)
    got = rows_of(decontamination.marked(d, i, block))
    want = plain_marks(docs, items)
    assert got == want and 50 < sum(r[5] for r in want) and any(r[2] == 0 and r[1] > 0 for r in want)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 4)
    docs, items = case(9)
    d, i = frames(spark, docs, items)
    assert rows_of(decontamination.marked(d, i)) == plain_marks(docs, items)


def test_long_texts_in_pieces(monkeypatch):
    docs, items = case(4)
    pieces = [(str(i), " ".join(words(t))) for i, t in items if words(t) and i is not None]
    texts = [*((t or "").encode() for _, t in docs), b"x" * 3000 + b" " + docs[90][1].encode(), b" " * 5000, (b"y" * 700 + b" ") * 30]
    whole = decontamination.Searcher(pieces).found(texts)
    monkeypatch.setattr(decontamination, "AT_ONCE", 50)
    monkeypatch.setattr(decontamination, "LANE", 7)
    assert decontamination.Searcher(pieces).found(texts) == whole


def test_marks_of_empty_tables(spark):
    docs, items = case()
    d, i = frames(spark, docs, items)
    assert decontamination.marked(d.limit(0), i).count() == 0
    got = decontamination.marked(d, i.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_items for r in got) and {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
