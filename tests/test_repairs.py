"""Borders that a drawing breaks, repaired within the run that extracts its regions."""

import pytest

from cartolith.plans import extraction


def run(spark, **more):
    """Two rooms side by side with a wide river between them, in a land a little larger."""
    wall = {(x, y) for x in range(1, 22) for y in range(1, 12) if x in (1, 9, 12, 21) or y in (1, 11)}
    barrier = spark.createDataFrame(sorted(wall), "x int, y int")
    seeds = spark.createDataFrame([(5, 5, 1), (15, 5, 2)], "x int, y int, region int")
    land = {(x, y) for x in range(24) for y in range(14) if not (9 <= x <= 12 and 0 < y < 12)}
    territory = spark.createDataFrame(sorted(land), "x int, y int")
    none = territory.where("false")
    return extraction.extract_linework(barrier, seeds, (0, 0, 23, 13), 4, 1, "country-001", territory, none, none, [(1, 2)], **more)


def test_repairs_within_the_run(spark):
    plain = run(spark)
    assert plain.borders.count() == 0 and plain.report.first().missing_pairs == 1
    made = run(spark, closures=[(2, 1)], extensions=[(1, 2)])
    rows = {r.repair: (r.a, r.b, r.part, [tuple(p) for p in r.points]) for r in made.borders.collect()}
    assert set(rows) == {"closure", "coast"} or set(rows) == {"closure"}
    (x0, y0), (x1, y1) = rows["closure"][3]
    assert rows["closure"][:3] == (1, 2, 1) and (abs(x1 - x0), abs(y1 - y0)) == (4.0, 0.0)
    assert made.report.first().missing_pairs == 0


def test_a_border_that_is_not_there_cannot_be_prolonged(spark):
    with pytest.raises(ValueError, match="can't be prolonged"):
        run(spark, extensions=[(1, 2)])
