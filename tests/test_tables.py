"""Tables of drawn pages beside a plain version, and components beside a walk."""

import random

from quire.operators import graph, tables

RULE = "doc string, page int, x0 double, y0 double, x1 double, y1 double"
KEYS = ["doc", "page"]


def walk(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300, 360)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7), (-1, -2)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a int, b int")
    assert {r.node: r.component for r in graph.components(df).collect()} == walk([x for x in links if x[0] != x[1]])
    assert graph.components(df.limit(0)).count() == 0


def plain(rules):
    """Tables of one page: (x0, y0, x1, y1, cells), by trying every pair of crossings."""
    level = [(y, a, b) for u, y, a, b in rules if not u]
    upright = [(x, a, b) for u, x, a, b in rules if u]

    def edges(rows):
        rows, out = sorted(rows), []
        groups = []
        for r in rows:
            if groups and r[0] - groups[-1][-1][0] <= 3:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            piece = []
            for at, a, b in sorted(g, key=lambda r: (r[1], r[2])):
                if piece and a > max(r[2] for r in piece) + 3:
                    out.append(piece)
                    piece = []
                piece.append((at, a, b))
            out.append(piece)
        out = [(min(r[0] for r in p), p[0][1], max(r[2] for r in p)) for p in out]
        return out

    h, v = edges(level), edges(upright)
    point = {(i, j) for i, (y, a, b) in enumerate(h) for j, (x, c, d) in enumerate(v) if a - 3 <= x <= b + 3 and c - 3 <= y <= d + 3}
    cells = []
    for i, j in point:
        right = next((n for n in range(j + 1, len(v)) if (i, n) in point and v[n][2] > h[i][0] + 3), None)
        below = next((n for n in range(i + 1, len(h)) if (n, j) in point and h[n][2] > v[j][0] + 3), None)
        if right is not None and below is not None and (below, right) in point:
            cells.append((i, j, below, right))
    links = [(("p", *p), ("c", n)) for n, (i, j, i2, j2) in enumerate(cells) for p in ((i, j), (i, j2), (i2, j), (i2, j2))]
    of = walk(links)
    found = {}
    for n, c in enumerate(cells):
        found.setdefault(of["c", n], []).append(c)
    return sorted((min(v[c[1]][0] for c in g), min(h[c[0]][0] for c in g), max(v[c[3]][0] for c in g), max(h[c[2]][0] for c in g), len(g)) for g in found.values() if len(g) > 1)


def page(rng):
    """Rules of a page: grids with gaps, slack and stray lines."""
    rules = []
    for _ in range(rng.randrange(1, 4)):
        x, y, n, m = rng.randrange(0, 400), rng.randrange(0, 500), rng.randrange(1, 6), rng.randrange(1, 5)
        for i in range(n + 1):
            a, b = x + 50 * rng.choice([0, 0, 0, 1]), x + 50 * (m - rng.choice([0, 0, 0, 1]))
            if b > a + 10:
                rules += [(False, y + 30 * i + rng.choice([0, 0.5, 2]), a, b)] if rng.random() < 0.7 else [(False, y + 30 * i, a, a + 20), (False, y + 30 * i + 1, a + 21.5, b)]
        for j in range(m + 1):
            rules.append((True, x + 50 * j + rng.choice([0, 1]), y + 30 * rng.choice([0, 0, 1]) - 2, y + 30 * n - rng.choice([0, 0, 30]) + 2))
    rules += [(bool(rng.randrange(2)), rng.randrange(0, 600), 100, 300) for _ in range(2)]
    return [r for r in rules if r[3] - r[2] >= 3]


def drawn(pages):
    return [(f"d{k % 5}", k, *map(float, (at, lo, at, hi) if up else (lo, at, hi, at))) for k, rules in enumerate(pages) for up, at, lo, hi in rules]


def test_tables_against_all_crossings(spark):
    rng = random.Random(11)
    pages = [page(rng) for _ in range(60)]
    lines = spark.createDataFrame(drawn(pages), RULE)
    got = {}
    for r in tables.tables(lines, lines.limit(0), KEYS).collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1, r.n_cells))
    want = {k: t for k, p in enumerate(pages) if (t := plain(p))}
    assert {k: sorted(t) for k, t in got.items()} == want and len(want) > 40 and max(len(t) for t in want.values()) > 1


def test_boxes_lines_and_likeness(spark):
    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 40.0), ("d", 1, 50.0, 0.0, 100.0, 40.0), ("d", 1, 0.0, 40.0, 100.0, 80.0), ("d", 2, 10.0, 10.0, 60.0, 60.0), ("d", 3, 5.0, 5.0, 200.0, 6.0)], RULE)
    lines = spark.createDataFrame([("d", 1, 300.0, 0.0, 400.0, 50.0), ("d", 2, 0.0, 300.0, 40.0, 300.5), ("d", 2, 0.0, 320.0, 20.0, 320.0)], RULE)
    blocks = spark.createDataFrame([("d", 1, x) for x in (6.0, 7.0, 11.9, 12.0, 13.0, -1.0, 1.0, 2.0)], "doc string, page int, x0 double")
    pages = spark.createDataFrame([("d", k) for k in range(1, 5)], "doc string, page int")
    rows = {r.page: r for r in tables.page_tables(pages, lines, boxes, blocks, KEYS).collect()}
    assert [(rows[k].table_count, rows[k].table_cells) for k in range(1, 5)] == [(1, 3), (0, 0), (0, 0), (0, 0)]
    import math

    likeness = lambda n, columns: round(0.6 * min(1.0, math.log1p(n) / math.log(60)) + 0.4 * min(1.0, columns / 5), 3)
    assert [rows[k].likeness for k in range(1, 5)] == [likeness(12, 2), likeness(5, 0), likeness(0, 0), 0.0]
    (one,) = tables.tables(lines, boxes, KEYS).collect()
    assert (one.x0, one.y0, one.x1, one.y1, one.n_cells, one.n_rows, one.n_columns, one.nth) == (0.0, 0.0, 100.0, 80.0, 3, 2, 2, 1)
    assert tables.tables(lines.limit(0), boxes.limit(0), KEYS).count() == 0
