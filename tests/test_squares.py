"""Joins through squares of several sizes, nearest targets in a tree, and gaps absorbed in order, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.operators import overlay, squares


def boxes_df(spark, boxes):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "id long, x0 double, y0 double, x1 double, y1 double")


def test_boxes_of_all_sizes_meet(spark):
    rng = random.Random(3)
    boxes = [(-1e6, -1e6, 1e6, 1e6), (0, 0, 0, 0), (5, 5, 5, 9), (64, 0, 128, 64), (63.999, 0, 64, 1), (-64, -64, 0, 0)]
    for _ in range(120):
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), 2 ** rng.uniform(-4, 9), 2 ** rng.uniform(-4, 9)
        boxes.append((x, y, x + w, y + h))
    want = {}
    for i, a in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            b = boxes[j]
            wide, tall = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if wide > 0 and tall > 0 and wide * tall > 1e-9:
                want[i, j] = wide * tall
    got = overlay.box_overlaps(boxes_df(spark, boxes)).collect()
    assert len(got) == len(want) and {(r["first"], r["second"]): r.area for r in got} == pytest.approx(want)
    assert overlay.box_overlaps(boxes_df(spark, [])).count() == 0


def test_a_huge_box_has_few_rows(spark):
    boxes = squares.keyed(boxes_df(spark, [(-1e6, -1e6, 1e6, 1e6), (3, 3, 4, 4)]).select("id", F.struct("x0", "y0", "x1", "y1").alias("box")).withColumn("level", squares.fitting(F.col("box"))))
    assert {r.id: r["count"] for r in boxes.groupBy("id").count().collect()} == {0: 4, 1: 4}


def test_points_in_boxes_of_several_levels(spark):
    rng = random.Random(4)
    boxes = [(-1e5, -1e5, 1e5, 1e5)] + [(x, y, x + w, y + w) for x, y, w in ((rng.randrange(-50, 50), rng.randrange(-50, 50), rng.choice([0, 1, 7, 60])) for _ in range(50))]
    points = [(k, float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60))) for k in range(80)]
    got = squares.in_boxes(spark.createDataFrame(points, "key long, x double, y double"), boxes_df(spark, boxes).select("id", F.struct("x0", "y0", "x1", "y1").alias("box")))
    want = {(k, i) for k, x, y in points for i, b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3]}
    rows = [(r.key, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize(("k", "before", "ties"), [(1, False, False), (3, False, False), (40, False, False), (1, True, True), (2, True, False)])
def test_nearest_in_a_tree(spark, monkeypatch, k, before, ties):
    monkeypatch.setattr(squares, "LEAF", 4)
    rng = random.Random(k)
    targets = [(f"t{i}", i, rng.choice("ab"), float(rng.randrange(-40, 40)), float(rng.randrange(-40, 40))) for i in range(150)]
    targets += [(f"c{i}", 150 + i, "a", 1000.0 + rng.random(), -1000.0) for i in range(60)]  # a dense cluster far away
    targets += [(f"d{i}", 300 + i, "b", 3.0, 3.0) for i in range(50)] + [("n", 400, "a", None, 1.0), ("m", 401, None, 0.0, 0.0)]
    points = [(i, rng.choice("abz"), float(rng.randrange(-90, 90)), float(rng.randrange(-90, 90)), rng.randrange(0, 400)) for i in range(60)] + [(60, "a", 1e6, 0.0, 200), (61, "a", None, 0.0, 10), (62, "a", float("nan"), 0.0, 10)]
    a = spark.createDataFrame(points, "key long, g string, x double, y double, late long")
    b = spark.createDataFrame(targets, "id string, ord long, g string, x double, y double")
    got = squares.nearest_in_tree(a, b, "g", "key", k, "late" if before else None, ties)
    want = set()
    for key, group, x, y, late in points:
        if x is None or x != x:
            continue
        near = sorted(((x - tx) ** 2 + (y - ty) ** 2, o, i) for i, o, tg, tx, ty in targets if tg == group and tx is not None and (not before or o < late))
        last = near[min(k, len(near)) - 1][0] if near else 0
        near = [n for n in near if n[0] <= last] if ties else near[:k]
        want |= {(key, p + 1, i, o, d) for p, (d, o, i) in enumerate(near)}
    assert {tuple(r) for r in got.select("key", "place", "id", "ord", "d2").collect()} == want
    assert squares.nearest_in_tree(a, b.where("false"), "g", "key", k).count() == 0


def test_a_point_meets_few_of_a_large_group(spark):
    n = 200_000
    targets = spark.range(n).select("id", F.col("id").alias("ord"), F.lit(1).alias("g"), (F.col("id") % 450).cast("double").alias("x"), F.floor(F.col("id") / 450).cast("double").alias("y"))
    points = spark.range(50).select(F.col("id").alias("key"), F.lit(1).alias("g"), (F.col("id") * 9 + 0.25).alias("x"), (F.col("id") * 8 + 0.25).alias("y"))
    rows = overlay.nearest_in_group(points, targets, "g", k=2).collect()
    assert len(rows) == 100 and {r.d2 for r in rows if r.place == 1} == {0.125}


def plain_absorb(own, territory):
    own = {c: o for c, o in own.items() if c in territory}
    left, gaps = territory - own.keys(), []
    while left:
        todo, mine = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            mine.add((x, y))
            for q in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        gaps.append(mine)
    for gap in sorted(gaps, key=lambda m: min((y, x) for x, y in m)):
        best = min(((x - a) ** 2 + (y - b) ** 2, o) for x, y in gap for (a, b), o in own.items())
        own |= dict.fromkeys(gap, best[1])
    return own


def test_gaps_wait_for_each_other(spark):
    # islands in a row: each is nearer to the one before than to any owner, whose turn has come
    own = {(0, 0): "b", (40, 0): "a"}
    territory = {(x, 0) for x in (0, 40)} | {(x, y) for x in (6, 12, 18, 24, 30) for y in (0, 1)} | {(30, 9), (36, 9)}
    assert plain_absorb(own, territory)[24, 0] == "b"
    rng = random.Random(5)
    for k in range(4):
        frame = [(o, x, y) for (x, y), o in own.items()]
        got = overlay.absorb_gaps(spark.createDataFrame(frame, "owner string, x int, y int"), spark.createDataFrame(sorted(territory), "x int, y int"))
        rows = [((r.x, r.y), r.owner) for r in got.collect()]
        assert len(rows) == len(territory) and dict(rows) == plain_absorb(own, territory)
        territory = {(rng.randrange(60), rng.randrange(40)) for _ in range(90)} | {(1, 1), (50, 30)}
        own = {(1, 1): "b", (50, 30): "a", rng.choice(sorted(territory)): "c"}


def test_gaps_without_owners_or_beyond_reach_stay(spark):
    territory = spark.createDataFrame([(0, 0), (9, 0), (12, 0)], "x int, y int")
    own = spark.createDataFrame([("a", 0, 0)], "owner string, x int, y int")
    assert overlay.absorb_gaps(own.where("false"), territory).count() == 0
    assert {r.x for r in overlay.absorb_gaps(own, territory, 5).collect()} == {0}
    assert {r.x for r in overlay.absorb_gaps(own, territory, 10).collect()} == {0, 9}
