"""Grids: states, fills, components, seals and boundaries on arrays made by hand."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import colors
from cartolith.operators import grid, overlay, topology
from cartolith.plans import extraction


def cells(spark, rows, names="x int, y int, seed int"):
    return spark.createDataFrame(rows, names)


def test_six_states_of_four_pixels(spark):
    pixels = spark.createDataFrame([(0, True, 200, 1, 1, 255), (1, True, 128, 128, 128, 255), (2, True, 0, 0, 0, 255), (3, False, 200, 1, 1, 255)], "x int, land boolean, r int, g int, b int, a int")
    got = {r.x: [k for k in colors.mask_states() if r[k]] for r in pixels.withColumns(colors.mask_states()).collect()}
    assert got == {0: ["country"], 1: ["unclaimed"], 2: ["unknown_land"], 3: ["ocean", "country_outside_land"]}
    with pytest.raises(ValueError):
        colors.check_colors((1, 1, 1), (1, 1, 1))


@pytest.mark.parametrize("tile", [512, 3])
def test_barrier_blocks_a_fill(spark, tile):
    rows = [(x, y, {(0, 2): 1, (6, 2): 2}.get((x, y), 0)) for x in range(7) for y in range(5) if x != 3]
    got = grid.flood(cells(spark, rows), tile=tile).collect()
    assert {(r.x, r.label) for r in got} == {(x, 1 if x < 3 else 2) for x in range(7) if x != 3}


@pytest.mark.parametrize("tile", [512, 3])
@pytest.mark.parametrize("steps", [grid.AROUND_8, grid.AROUND_4])
def test_fill_is_that_of_a_queue(spark, tile, steps):
    rng = random.Random(5)
    land = {(x, y): rng.choice([0] * 9 + [1, 2, 3]) for x in range(8) for y in range(7) if rng.random() < 0.8}
    want, queue = {p: (s, 0) for p, s in land.items() if s}, deque(sorted((p for p, s in land.items() if s), key=lambda p: (p[1], p[0])))
    while queue:
        x, y = queue.popleft()
        for dx, dy in steps:
            p = (x + dx, y + dy)
            if p in land and p not in want:
                want[p] = (want[x, y][0], want[x, y][1] + 1)
                queue.append(p)
    got = {(r.x, r.y): (r.label, r.distance) for r in grid.flood(cells(spark, [(*p, s) for p, s in land.items()]), steps, tile).collect()}
    assert got == {p: want.get(p, (0, -1)) for p in land}


@pytest.mark.parametrize(("tile", "few"), [(3, 0), (3, 1000), (512, 1000)])
def test_components_do_not_depend_on_tiles(spark, tile, few):
    rng = random.Random(2)
    here = [(x, y) for x in range(12) for y in range(12) if rng.random() < 0.45]
    got = {(r.x, r.y): r.component for r in grid.components(spark.createDataFrame(here, "x int, y int"), grid.AROUND_8, tile, few).collect()}
    for x, y in here:
        near = [(x + dx, y + dy) for dx, dy in grid.AROUND_8 if (x + dx, y + dy) in got]
        assert all(got[p] == got[x, y] for p in near)
    assert all(c == min(b * (1 << 32) + a for (a, b), d in got.items() if d == c) for c in set(got.values()))


@pytest.mark.parametrize("far", [9, 400])
def test_nearest_seeds_are_those_of_brute_force(spark, far):
    rng = random.Random(far)
    here = [(rng.randrange(far), rng.randrange(far)) for _ in range(60)]
    seeds = {(rng.randrange(far), rng.randrange(far)): rng.randrange(1, 5) for _ in range(12)}
    got = grid.nearest_seed(spark.createDataFrame(here, "x int, y int"), spark.createDataFrame([(*p, v) for p, v in seeds.items()], "x int, y int, label int"))
    want = {(x, y): min(((x - a) ** 2 + (y - b) ** 2, b, a) for a, b in seeds) for x, y in here}
    assert {(r.x, r.y): (r.d2, r.label) for r in got.collect()} == {p: (d, seeds[a, b]) for p, (d, b, a) in want.items()}


def test_linework_gives_every_enclosed_cell(spark):
    wall = {(x, y) for x in range(3, 14) for y in range(3, 10) if x in (3, 8, 13) or y in (3, 9)} - {(5, 3)}
    lines, box = spark.createDataFrame(sorted(wall), "x int, y int"), (0, 0, 16, 12)
    seeds = spark.createDataFrame([(5, 6, 1), (10, 6, 2)], "x int, y int, region int")
    with pytest.raises(Exception, match="seed is in no face"):  # the gap lets the outside in
        extraction.linework_regions(lines, seeds, box, 3).count()
    got = {(r.x, r.y): r.region for r in extraction.linework_regions(lines, seeds, box, 3, 3).collect()}
    faces = {(x, y): 1 if x < 8 else 2 for x in range(4, 13) for y in range(4, 9) if x != 8}
    inside = {(x, y) for x in range(3, 14) for y in range(3, 10)}
    near = lambda p: min(((p[0] - a) ** 2 + (p[1] - b) ** 2, b, a, v) for (a, b), v in faces.items())[3]
    assert got == {p: faces.get(p) or near(p) for p in inside}


def test_photos_of_several_owners(spark):
    cells = [(o, x + dx, y, -1 if x == 4 and o == "a" else 0) for o, dx in (("a", 0), ("b", 5), ("c", 2)) for x in range(9) for y in range(4)]
    got = extraction.photo_regions(spark.createDataFrame(cells, "owner string, x int, y int, value int"), 2).collect()
    assert {(r.owner, r.x, r.y) for r in got} == {c[:3] for c in cells}
    assert {o: sorted({r.label for r in got if r.owner == o}) for o in "abc"} == {"a": [1, 2], "b": [1], "c": [1]}
    assert all(r.label == 1 for r in got if r.owner == "a" and r.x == 4)


def test_empty_grids(spark):
    none = spark.createDataFrame([], "x int, y int, seed int")
    assert grid.flood(none).count() == 0
    assert grid.components(none).count() == 0
    assert topology.polygons(none.withColumnRenamed("seed", "label")).count() == 0


def test_a_square_with_a_hole_and_an_island(spark):
    rows = [(x, y, 1) for x in range(5) for y in range(5) if not (1 <= x <= 2 and 1 <= y <= 3)] + [(5, 5, 1), (9, 9, 1)]
    (row,) = topology.polygons(cells(spark, rows, "x int, y int, label int")).collect()
    assert [len(p) for p in row["shape"]] == [2, 1, 1]  # corners that only touch stay apart
    from cartolith.functions import geometry as g

    df = spark.createDataFrame([row], f"label int, shape {topology.SHAPE}")
    assert df.select(g.area(F.col("shape"))).first()[0] == len(rows)


def test_arcs_are_shared_and_cover_all_edges(spark):
    rng = np.random.default_rng(0)
    labels = spark.createDataFrame([(x, y, int(rng.integers(0, 4))) for x in range(9) for y in range(8)], "x int, y int, label int")
    edges = topology.interfaces(labels)
    lines = topology.arcs(edges).collect()
    length = sum(abs(p["x"] - q["x"]) + abs(p["y"] - q["y"]) for r in lines for p, q in zip(r.points, r.points[1:], strict=False))
    assert length == edges.count()
    ids = spark.createDataFrame([(i, f"country-{i:03d}") for i in range(1, 4)], "label int, id string")
    inner, coast, vertices = topology.borders(topology.arcs(edges), ids)
    assert inner.select("id").distinct().count() == inner.count() == sum(r.a > 0 for r in lines)
    assert coast.count() == sum(r.a == 0 for r in lines) and vertices.select("id").distinct().count() == vertices.count()


def test_equal_masks_score_one(spark):
    mask = spark.createDataFrame([(x, y, int(6 <= x < 24 and 4 <= y < 28)) for x in range(32) for y in range(32)], "x int, y int, value int")
    row = overlay.boundary_metrics(mask, mask, 3).first()
    assert row.iou == 1 and row.boundary_f == pytest.approx(1)


def test_holes_fill_and_gaps_go_to_the_nearest(spark):
    ring = spark.createDataFrame([(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)], "x int, y int")
    assert grid.fill_holes(ring).count() == 25
    own = spark.createDataFrame([("a", 0, 0), ("b", 9, 0)], "owner string, x int, y int")
    whole = spark.createDataFrame([(x, 0) for x in range(10)], "x int, y int")
    assert {(r.owner, r.x) for r in overlay.absorb_gaps(own, whole, 10).collect()} == {("a", x) for x in range(9)} | {("b", 9)}


def test_fill_reports_and_guards(spark):
    pixels = [(x, 0, *((200, 0, 0) if x == 0 else (0, 0, 0)), 255) for x in range(6)] + [(9, 0, 0, 0, 0, 255)]
    land = spark.createDataFrame([(p[0], 0, 1) for p in pixels], "x int, y int, land int")
    states = extraction.with_states(spark.createDataFrame(pixels, "x int, y int, r int, g int, b int, a int"), land)
    labels = spark.createDataFrame([(0, 0, 7)], "x int, y int, label int")
    fill = extraction.fill_countries(states, labels, most=2)
    row = fill.report.first()
    assert (row.missing, row.reachable, row.filled, row.unresolved, row.p50, row.maximum) == (6, 5, 2, 4, 3, 5)
    assert {r.cause for r in fill.unresolved.collect()} == {"seedless-land-component", "beyond-safe-distance"}
    islands = spark.createDataFrame([(9, 0, 7)], "x int, y int, label int")
    assert extraction.fill_countries(states, labels, islands, "full").report.first().unresolved == 0
    with pytest.raises(Exception, match="island"):
        extraction.fill_countries(states, labels, spark.createDataFrame([(1, 0, 7)], "x int, y int, label int"))
