"""Deepest points of long shapes, of shapes with many corners, and of many shapes from one file."""

import time

import numpy as np
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import shapes


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def test_a_long_box_is_halved_in_steps():
    began = time.process_time()
    x, y, clearance = shapes.deepest_point([box(0, 0, 44, 60000)], 0.05)
    assert time.process_time() - began < 10 and clearance == 22 and x == 22


def test_many_holes():
    holes = [box(i, j, i + 1, j + 1) for i in range(2, 30, 3) for j in range(2, 3000, 3) if (i, j) != (14, 1502)]
    began = time.process_time()
    x, y, clearance = shapes.deepest_point([box(0, 0, 32, 3001), *holes], 0.01)
    assert time.process_time() - began < 10
    index = shapes.EdgeIndex([box(0, 0, 32, 3001), *holes])
    # between the four holes around the one that isn't there
    assert abs(clearance - 2.5) < 0.011 and abs(x - 14.5) < 0.5 and abs(y - 1502.5) < 0.5 and abs(index.distance(x, y) - clearance) < 1e-9


def test_shapes_of_one_partition_are_dealt(spark):
    p = lambda x, y: g.point(F.col(x), F.col(y))
    boxes = spark.range(60, numPartitions=1).select("id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") + 4.0).alias("x1"), F.lit(6.0).alias("y1"))
    made = boxes.select("id", F.array(F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")))).alias("shape"))
    found = shapes.inner_points(made, 0.01)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {r.id: r.clearance for r in found.collect()} == {i: min(i + 4, 6) / 2 for i in range(60)}


def test_largest_of_very_many_polygons(spark):
    small = F.transform(F.sequence(F.lit(0), F.lit(150_000)), lambda i: F.array(F.transform(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))), lambda p: g.point(p["x"] + 2 * i, p["y"]))))
    large, hole = (F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in line)) for line in (box(0, 10, 9, 19).tolist(), box(1, 11, 8, 18).tolist()))
    shape = F.concat(small, F.array(F.array(large, hole)), small)
    one = spark.range(1).select("id", shape.alias("shape"))
    one.write.mode("overwrite").format("noop").save()
    began = time.time()
    row = shapes.inner_points(one, 0.01).first()
    took = time.time() - began
    assert took < 10 and abs(row.clearance - 0.5857) < 0.02 and (row.y < 11 or row.y > 18)
