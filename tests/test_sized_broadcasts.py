"""Tables that pack well, and boxes that are made by exploding, don't go through the driver."""

from pyspark.sql import functions as F

from cartolith.operators import fits, grid
from cartolith.plans import extraction
from cartolith.session import written


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_packed_tables_are_not_broadcast(spark):
    cells = spark.range(1_000_000).select((F.col("id") % 150).cast("int").alias("x"), F.floor(F.col("id") / 150).cast("int").alias("y"))
    first, second = written(cells, "first"), written(cells.where("x < 100"), "second")
    both = first.join(second, ["x", "y"])
    assert "Broadcast" not in plan(both) and both.count() == 666_700


def test_placed_regions_and_boxes_are_not_broadcast(spark):
    cells = spark.createDataFrame([("a", x, y) for x in range(8) for y in range(6)], "owner string, x int, y int")
    twice = spark.createDataFrame([(x, y) for x in range(16) for y in range(12)], "x int, y int")
    moved, fit = extraction.place_regions(cells, twice, 2.0, 2.0, 1.0, 0)
    assert "Broadcast" not in plan(moved) and moved.count() == 192 and fit.first().iou == 1
    box = grid.box_cells(spark, 0, 0, 149, 4000)
    assert "Broadcast" not in plan(box.join(written(box, "box"), ["x", "y"], "left_anti"))


def test_photo_regions_are_not_broadcast(spark):
    cells = spark.range(6000).select(F.lit("p").alias("owner"), (F.col("id") % 60).cast("int").alias("x"), F.floor(F.col("id") / 60).cast("int").alias("y"))
    found = extraction.photo_regions(cells.withColumn("value", F.when((F.col("x") % 20 == 10) | (F.col("y") % 15 == 7), -1).otherwise(0)), 5)
    assert "Broadcast" not in plan(found) and found.count() == 6000 and found.select("label").distinct().count() == 4 * 8


def test_a_fit_that_bounds_tell_looks_at_one_window(spark, monkeypatch):
    for name, value in (("WHOLE", 10), ("COARSE", 60)):
        monkeypatch.setattr(fits, name, value)
    seen, covered = [], fits._covered
    monkeypatch.setattr(fits, "_covered", lambda windows, *more: seen.append(len(windows)) or covered(windows, *more))
    cells = spark.range(3000).select((F.col("id") % 30).alias("x"), F.floor(F.col("id") / 30).alias("y")).where("(x * 7 + y * 13) % 10 < 7")
    twice = cells.select((F.col("x") * 2).alias("x"), F.explode(F.array(F.col("y") * 2, F.col("y") * 2 + 1)).alias("y"))
    row = fits.best_fit(cells, twice.union(twice.select(F.col("x") + 1, "y")), 1.5, 2.5, 0.25).first()
    assert tuple(row) == (2.0, 0.0, 0.0, 1.0) and seen == [1]
