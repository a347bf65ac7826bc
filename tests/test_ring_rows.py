"""Figures of outlines come from rows of rings; no label's shape is put together for them."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith import catalog
from cartolith.functions import geometry as g
from cartolith.operators import topology

catalog.load()


@pytest.mark.parametrize("name", ["contour_areas", "topology_report", "land_outline"])
def test_figures_without_shapes(spark, sf_dir, monkeypatch, name):
    for whole in ("polygons", "contours"):
        monkeypatch.setattr(topology, whole, lambda *of: pytest.fail("shapes were put together"))
    found = catalog.QUERIES[name](spark, sf_dir)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString() and found.count() >= 1


@pytest.mark.parametrize("tolerance", [0.0, 1.5])
def test_rings_have_the_areas_of_shapes(spark, tolerance):
    rng = random.Random(1)
    cells = spark.createDataFrame([(x, y, rng.choice((1, 2, 2))) for x in range(40) for y in range(30) if rng.random() < 0.7], "x int, y int, label int")
    want = {r.label: r.a for r in topology.contours(cells, tolerance, 0.5).select("label", g.area(F.col("shape")).alias("a")).collect()}
    got = {r.label: r.area for r in topology.ring_areas(topology.contour_rings(cells, tolerance, 0.5)).collect()}
    assert got == pytest.approx(want)
