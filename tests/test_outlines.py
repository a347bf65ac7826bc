"""Outlines pieced together over small tiles: against cells, and the same whatever the tiles and the way of ranking."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.operators import chains, topology
from cartolith.session import written


def grid_of(rng, wide, high, labels):
    return {(x, y): rng.randrange(labels + 1) for x in range(wide) for y in range(high)}


def labels_df(spark, grid):
    return spark.createDataFrame([(x, y, v) for (x, y), v in sorted(grid.items())] or [], "x int, y int, label int")


def area2(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:], strict=False))


def inside(ring, x, y):
    return sum((a["y"] > y) != (b["y"] > y) and a["x"] > x for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1


def four_components(cells):
    left, out = set(cells), []
    while left:
        todo, mine = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            mine.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(mine)
    return out


@pytest.mark.parametrize(("tile", "few"), [(4, 10**6), (5, 0), (512, 10**6)])
def test_polygons_hold_their_cells(spark, tile, few):
    rng = random.Random(tile)
    grid = grid_of(rng, 17, 15, 2) | {(x, y): 3 for x in range(20, 34) for y in range(15) if (x, y) not in {(22, 3), (24, 3), (26, 3), (26, 4), (30, 9)}}
    shapes = {r.label: r["shape"] for r in topology.polygons(labels_df(spark, grid), tile, few).collect()}
    assert sorted(shapes) == [1, 2, 3]
    for label, shape in shapes.items():
        parts = four_components([c for c, v in grid.items() if v == label])
        assert len(shape) == len(parts)
        for polygon in shape:
            assert area2(polygon[0]) > 0 and all(area2(h) < 0 for h in polygon[1:])
            held = {(x, y) for x in range(35) for y in range(16) if inside(polygon[0], x + 0.5, y + 0.5) and not any(inside(h, x + 0.5, y + 0.5) for h in polygon[1:])}
            assert held in parts
            assert all(r[0] == r[-1] == min(r, key=lambda p: (p["x"], p["y"])) for r in polygon)
        assert [(min(p["y"] for p in s[0]), min(p["x"] for p in s[0])) for s in shape] == sorted((min(p["y"] for p in s[0]), min(p["x"] for p in s[0])) for s in shape)
    assert len(shapes[3][0]) == 1 + 4


def plain_arcs(edges):
    """Sorted unit segments of each line, by walking."""
    out = defaultdict(list)
    by = defaultdict(list)
    for e in edges:
        by[e[:2]].append(((e[2], e[3]), (e[4], e[5])))
    for pair, segments in by.items():
        at = defaultdict(list)
        for s in segments:
            for p in s:
                at[p].append(s)
        left = set(segments)
        while left:
            line, todo = set(), [left.pop()]
            while todo:
                s = todo.pop()
                line.add(s)
                for p in s:
                    if len(at[p]) == 2:
                        todo += [t for t in at[p] if t in left]
                        left -= set(at[p])
            out[pair].append(frozenset(line))
    return {k: sorted(map(sorted, v)) for k, v in out.items()}


def unit(points):
    out = []
    for a, b in zip(points, points[1:], strict=False):
        n = int(abs(b["x"] - a["x"]) + abs(b["y"] - a["y"]))
        dx, dy = np.sign(b["x"] - a["x"]), np.sign(b["y"] - a["y"])
        for i in range(n):
            p, q = (int(a["x"] + i * dx), int(a["y"] + i * dy)), (int(a["x"] + (i + 1) * dx), int(a["y"] + (i + 1) * dy))
            out.append((min(p, q), max(p, q)))
    return out


@pytest.mark.parametrize("few", [10**6, 0])
def test_arcs_are_the_same_over_any_tiles(spark, few):
    rng = random.Random(9)
    grid = grid_of(rng, 14, 11, 2) | {(x, y): 3 for x in range(16, 40) for y in range(2, 10)} | {(x, y): 4 for x in range(22, 31) for y in range(4, 7)}
    edges = written(topology.interfaces(labels_df(spark, grid)), "edges")
    want = plain_arcs([tuple(r) for r in edges.select("a", "b", "x0", "y0", "x1", "y1").collect()])
    seen = None
    for tile in (4, 7, 512):
        rows = topology.arcs(edges, tile=tile, few=few).collect()
        got = defaultdict(list)
        for r in rows:
            got[r.a, r.b].append(sorted(unit(r.points)))
        assert {k: sorted(v) for k, v in got.items()} == want
        for pair, parts in got.items():
            assert sorted(r.part for r in rows if (r.a, r.b) == pair) == list(range(1, len(parts) + 1))
        lines = sorted((r.a, r.b, r.part, [tuple(p) for p in r.points]) for r in rows)
        assert seen in (None, lines)
        seen = lines
    ring = [points for a, b, _, points in seen if (a, b) == (3, 4)]
    assert ring == [[(22.0, 4.0), (22.0, 7.0), (31.0, 7.0), (31.0, 4.0), (22.0, 4.0)]]


def test_ranks_by_rows_and_in_one_task_agree(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10**12), 300)
    following = {}
    for chain, ring in ((nodes[:1], True), (nodes[1:40], True), (nodes[40:41], False), (nodes[41:170], False), (nodes[170:], True)):
        following |= dict(zip(chain, chain[1:] + [chain[0] if ring else None], strict=True))
    links = written(spark.createDataFrame(list(following.items()), "node long, next long"), "links")
    found = [{r.node: (r.leader, r.ahead) for r in chains.ranked(links, few).collect()} for few in (10**6, 0)]
    assert found[0] == found[1] and len(found[0]) == 300
    for node, (leader, ahead) in found[0].items():
        here = node
        for _ in range(ahead):
            here = following[here]
        assert here == leader
        assert following[leader] is None or leader == min(found[0][n][0] for n in [leader])


def test_a_large_label_spreads_over_tasks(spark):
    """A comb of 200 teeth: no task has more than a tile's edges of it."""
    cells = spark.range(0, 400 * 300).select((F.col("id") % 400).cast("int").alias("x"), F.floor(F.col("id") / 400).cast("int").alias("y"), F.lit(1).alias("label")).where("y = 0 or x % 2 = 0")
    most = []

    edges = topology.label_edges(cells).withColumns({"tx": F.floor(F.col("x0") / 64), "ty": F.floor(F.col("y0") / 64)})
    most = edges.groupBy("tx", "ty").count().agg(F.max("count")).first()[0]
    assert most <= 4 * 64 * 64 and edges.count() > 8 * most
    pieces, rings = topology.ring_pieces(cells, 64)
    (ring,) = rings.collect()
    assert ring.area == cells.count() and ring.parent == ring.ring
    assert pieces.count() > 100
    (shape,) = topology.polygons(cells, 64).collect()
    assert len(shape["shape"]) == 1 and len(shape["shape"][0]) == 1


def test_empty_grid_and_repeated_cells(spark):
    none = labels_df(spark, {})
    assert topology.polygons(none).count() == 0 and topology.arcs(topology.interfaces(none)).count() == 0
    twice = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 0, 1), (-1, -5, 2)], "x int, y int, label int")
    got = {r.label: [[tuple(p) for p in ring] for ring in r["shape"][0]] for r in topology.polygons(twice).collect()}
    assert got == {1: [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]], 2: [[(-1.0, -5.0), (0.0, -5.0), (0.0, -4.0), (-1.0, -4.0), (-1.0, -5.0)]]}


def test_pieces_of_a_pinched_ring_turn_right():
    table = pa.table({"label": [1] * 8, "x0": [0, 1, 1, 0, 1, 2, 2, 1], "y0": [0, 0, 1, 1, 1, 1, 2, 2], "x1": [1, 1, 0, 0, 2, 2, 1, 1], "y1": [0, 1, 1, 0, 1, 2, 2, 1]})
    got = chains.ring_pieces(table)
    assert got.column("closed").to_pylist() == [True, True] and sorted(got.column("area").to_pylist()) == [1, 1]
