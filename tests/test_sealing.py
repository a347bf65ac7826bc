"""Sealed borders and merged faces on tiles, cell by cell against walks over whole grids."""

import random
from collections import Counter

import pytest

from cartolith import catalog
from cartolith.catalog import fixtures as fx
from cartolith.operators import sealing
from cartolith.plans import extraction

STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def box(cells):
    return min(x for x, _ in cells), min(y for _, y in cells), max(x for x, _ in cells), max(y for _, y in cells)


def plain_seal(cells, gaps=True):
    v = dict(cells)
    x0, y0, x1, y1 = box(cells)
    for y in range(y0, y1):
        for x in range(x0, x1):
            a, b, c, d = ((x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1))
            if v.get(a) == -1 == v.get(d) and v.get(b) == 0 == v.get(c):
                v[b] = -1
            if v.get(c) == -1 == v.get(b) and v.get(a) == 0 == v.get(d):
                v[a] = -1
    for y in range(y0 + 1, y1) if gaps else ():
        for x in range(x0 + 1, x1):
            if v.get((x, y)) == 0 and (v.get((x - 1, y)) == -1 == v.get((x + 1, y)) or v.get((x, y - 1)) == -1 == v.get((x, y + 1))):
                v[x, y] = -1
    return v


def plain_merge(labels, least):
    labels, size = dict(labels), Counter(v for v in labels.values() if v > 0)
    for name in sorted(size):
        if size[name] < least:
            best, most = 0, 0
            for x, y in sorted((c for c, v in labels.items() if v == name), key=lambda c: (c[1], c[0])):
                for dx, dy in STEPS:
                    near = labels.get((x + dx, y + dy), 0)
                    if near > 0 and near != name and size[near] > most:
                        best, most = near, size[near]
            if best:
                labels = {c: best if v == name else v for c, v in labels.items()}
    return labels


def plain_regions(cells, least):
    """Whole extraction of one owner: faces by their first cells, borders to the face that a queue brings first."""
    v = plain_seal(cells)
    left, labels = {c for c, k in v.items() if k == 0}, {}
    for c in sorted(left, key=lambda c: (c[1], c[0])):
        if c not in labels:
            name, todo = len(set(labels.values())) + 1, [c]
            labels[c] = name
            while todo:
                x, y = todo.pop()
                for q in ((x + dx, y + dy) for dx, dy in STEPS):
                    if q in left and q not in labels:
                        labels[q] = name
                        todo.append(q)
    front = sorted(labels, key=lambda c: (c[1], c[0]))
    rank = {c: i for i, c in enumerate(front)}
    while front:
        reached = {}
        for c in front:
            for q in ((c[0] + dx, c[1] + dy) for dx, dy in STEPS):
                if q in v and q not in labels:
                    reached[q] = min(reached.get(q, (rank[c], labels[c])), (rank[c], labels[c]))
        for q, (r, name) in reached.items():
            rank[q], labels[q] = r, name
        front = list(reached)
    return plain_merge({c: labels.get(c, 0) for c in v}, least)


def frame(spark, owners, column="value"):
    rows = [(o, x, y, v) for o, cells in owners.items() for (x, y), v in sorted(cells.items())]
    return spark.createDataFrame(rows, f"owner string, x int, y int, {column} int")


def drawn(rng, wide, high, share):
    cells = {(x, y): -1 if rng.random() < share else 0 for x in range(wide) for y in range(high) if rng.random() < 0.97}
    return cells | {(x, y): sealing.NEITHER for x, y in [(3, 3)] if (x, y) in cells}


@pytest.mark.parametrize("tile", [3, 7, 512])
def test_seals_as_a_walk_does(spark, tile):
    rng = random.Random(tile)
    stairs = {(x, y): 0 for x in range(14) for y in range(14)} | {(1, 0): -1, (1, 2): -1} | {(k + 2, k + 1): -1 for k in range(1, 11)} | {(k, k + 2): -1 for k in range(1, 11)}
    owners = {"a": drawn(rng, 20, 17, 0.35), "b": {(x + 5, y + 8): v for (x, y), v in drawn(rng, 13, 22, 0.5).items()}, "c": {(0, 0): 0}, "stairs": stairs}
    for gaps in (False, True):
        got = sealing.sealed(frame(spark, owners), gaps, tile).collect()
        want = {(o, x, y): v for o, cells in owners.items() for (x, y), v in plain_seal(cells, gaps).items()}
        assert len(got) == len(want) and {(r.owner, r.x, r.y): r.value for r in got} == want
    assert sealing.sealed(frame(spark, owners).where("false"), True, tile).count() == 0


def test_faces_merge_as_a_walk_does(spark):
    rng = random.Random(4)
    owners = {}
    for o in "abcd":
        cells = {(x, y): rng.choice([0, -1, 1, 2, 3, 4, 4, 4, 5, 6, 7]) for x in range(12) for y in range(9)}
        owners[o] = cells | {(x, 20): 30 - x for x in range(8)}
    for least in (1, 5, 12, 100):
        got = sealing.without_noise(frame(spark, owners, "label"), least).collect()
        want = {(o, x, y): v for o, cells in owners.items() for (x, y), v in plain_merge(cells, least).items()}
        assert len(got) == len(want) and {(r.owner, r.x, r.y): r.label for r in got} == want


def test_regions_of_photos_cell_by_cell(spark):
    rng = random.Random(6)
    owners = {"a": drawn(rng, 24, 15, 0.3), "b": {(x + 4, y): v for (x, y), v in drawn(rng, 11, 19, 0.2).items()}}
    owners = {o: {c: v for c, v in cells.items() if v != sealing.NEITHER} for o, cells in owners.items()}
    got = {(r.owner, r.x, r.y): r.label for r in extraction.photo_regions(frame(spark, owners), 4).collect()}
    want = {(o, x, y): v for o, cells in owners.items() for (x, y), v in plain_regions(cells, 4).items()}
    assert got == want


def test_the_query_of_photos_cell_by_cell(spark, sf_dir):
    catalog.load()
    cells = {(r.x, r.y): -1 if r.x % 20 == 10 or r.y % 15 == 7 else 0 for r in fx.grid(spark, sf_dir).select("x", "y").collect()}
    want = Counter(plain_regions(cells, 5).values())
    assert {r.label: r.area for r in catalog.QUERIES["photo_regions"](spark, sf_dir).collect()} == want
