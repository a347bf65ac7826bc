"""Shapes whose polygons have unlike numbers of rings, and the bounds of fits."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import shapes, topology


def cells():
    """A block with two holes, a block with one, and a single cell."""
    out = {(x, y) for x in range(12) for y in range(9)} - {(2, 2), (3, 2), (8, 5)}
    out |= {(x, y) for x in range(20, 27) for y in range(7)} - {(22, 3)}
    return out | {(40, 1)}


@pytest.fixture(scope="module")
def made(spark):
    return topology.polygons(spark.createDataFrame([(x, y, 1) for x, y in sorted(cells())], "x int, y int, label int")).select(F.col("label").alias("id"), "shape")


def test_rasters_give_back_the_cells(made):
    assert {(r.x, r.y) for r in shapes.rasterized(made).collect()} == cells()


def test_deepest_point_is_that_of_a_fine_grid(made):
    row = shapes.inner_points(made, 0.01).first()
    rings = [np.array([(p["x"], p["y"]) for p in r]) for r in made.first()["shape"][0]]
    edges = shapes.EdgeIndex(rings)
    best = max(edges.distance(x, y) for x in np.arange(0, 12, 0.1) for y in np.arange(0, 9, 0.1))
    assert row.clearance >= best - 0.011
    assert abs(edges.distance(row.x, row.y) - row.clearance) < 1e-9


def test_distance_is_negative_outside_and_in_holes(made):
    rings = [np.array([(p["x"], p["y"]) for p in r]) for r in made.first()["shape"][0]]
    edges = shapes.EdgeIndex(rings)
    assert edges.distance(3.0, 2.5) == -0.5
    assert edges.distance(-2.0, 4.5) == -2.0
    assert edges.distance(0.75, 7.5) == 0.75


def test_contours_without_tolerance_are_the_outlines(spark):
    labels = spark.createDataFrame([(x, y, 1) for x, y in sorted(cells())], "x int, y int, label int")
    area = topology.contours(labels, 0.0, 0.5).select(g.area(F.col("shape")).alias("a")).first().a
    assert area == len(cells())


def test_empty_shapes(spark):
    none = spark.createDataFrame([], f"id int, shape {topology.SHAPE}")
    assert shapes.rasterized(none).count() == 0
    assert shapes.inner_points(none).count() == 0


def plain_distance(x, y, rings):
    best, inside = np.inf, False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
            dx, dy = bx - ax, by - ay
            t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1)))
            best = min(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
            if (ay > y) != (by > y) and x < ax + dx * (y - ay) / dy:
                inside = not inside
    return best if inside else -best


def test_indexed_distances_are_those_over_all_edges():
    turn = np.linspace(0, 2 * np.pi, 701)
    outer = np.stack([(50 + 9 * np.sin(13 * turn)) * np.cos(turn), (40 + 7 * np.cos(9 * turn)) * np.sin(turn)], axis=1)
    outer[-1] = outer[0]
    hole = np.array([(-5.0, -5.0), (-5.0, 5.0), (5.0, 5.0), (5.0, -5.0), (-5.0, -5.0)])
    index = shapes.EdgeIndex([outer, hole])
    for x, y in np.random.default_rng(3).uniform(-70, 70, (200, 2)).tolist() + [(0.0, 0.0), (5.0, 5.0), (300.0, 0.0)]:
        assert index.distance(x, y) == pytest.approx(plain_distance(x, y, [outer, hole]), abs=1e-9)


def test_an_outline_of_many_edges_is_quick():
    turn = np.linspace(0, 2 * np.pi, 100_001)
    ring = np.stack([(1000 + 5 * np.sin(997 * turn)) * np.cos(turn), (800 + 5 * np.cos(501 * turn)) * np.sin(turn)], axis=1)
    ring[-1] = ring[0]
    began = time.process_time()
    x, y, clearance = shapes.deepest_point([ring], 0.05)
    assert time.process_time() - began < 4 and 780 < clearance < 810
