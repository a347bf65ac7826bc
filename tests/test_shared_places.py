"""Points at one place, equal shapes and equal boxes are looked at once."""

import itertools
import random

from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import overlay, squares


def boxed(spark, boxes):
    p = lambda x, y: g.point(F.col(x), F.col(y))
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in boxes], "id long, x0 double, y0 double, x1 double, y1 double")
    return df, df.select("id", F.array(F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")))).alias("shape"))


def some(n):
    rng = random.Random(n)
    kinds = [(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(12))]
    return [(i, rng.choice(kinds)) for i in rng.sample(range(10 * n), n)]


def test_first_holder_asks_once_for_a_place(spark, monkeypatch):
    boxes, seen, asked = some(100), [], overlay.points_in_shapes
    monkeypatch.setattr(overlay, "points_in_shapes", lambda p, s: seen.append((p.count(), s.count())) or asked(p, s))
    points = [(k, float(k % 5 * 5), float(k % 7 * 3)) for k in range(200)] + [(0, 3.0, 3.0), (300, None, 1.0)]
    got = overlay.first_holder(spark.createDataFrame(points, "key long, x double, y double"), boxed(spark, boxes)[1], "key", "id").collect()
    want = {}
    for k, x, y in points:
        for i, (x0, y0, x1, y1) in boxes:
            if x is not None and x0 <= x <= x1 and y0 <= y <= y1:
                want[k] = min(i, want.get(k, i))
    assert len(got) == len(want) and {r.key: r.id for r in got} == want and seen[0][0] <= 37 and seen[0][1] <= 12


def test_nearest_asks_once_for_a_place(spark):
    rng = random.Random(2)
    targets = [(f"t{i}", rng.randrange(50), rng.choice("ab"), float(rng.randrange(9)), float(rng.randrange(9))) for i in range(200)]
    points = [(k, rng.choice("ab"), k % 7 + 0.5, float(k % 5) * 4) for k in range(150)] + [(0, "a", 2.0, 2.0), (999, "a", 90.0, 0.0), (998, None, 1.0, 1.0)]
    a, b = spark.createDataFrame(points, "key long, g string, x double, y double"), spark.createDataFrame(targets, "id string, ord long, g string, x double, y double")
    for group in (None, "g"):
        want = {}
        for k, mine, x, y in points:
            near = [((x - tx) ** 2 + (y - ty) ** 2, o, i) for i, o, tg, tx, ty in targets if group is None or tg == mine]
            near = [n for n in near if n[0] < 9]
            if near:
                want[k] = min(*near, want.get(k, min(near)))
        got = overlay.nearest(a, b, 3.0, group=group)
        rows = got.collect()
        assert len(rows) == len(want) and {r.key: (r.d2, r.id) for r in rows} == {k: (d, i) for k, (d, _, i) in want.items()}
    # the join in squares sees places, not points
    many = spark.range(400_000).select(F.col("id").alias("key"), (F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"))
    to = spark.range(3000).select("id", F.col("id").alias("ord"), (F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("y"))  # 1.2e9 pairs of points and targets
    found = overlay.nearest(many, to, 8.0).agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("d2"), F.max("id").alias("id")).first()
    assert tuple(found) == (400_000, 100_000 * (1 + 1 + 2 + 5), 1)


def test_equal_boxes_meet_as_one(spark, monkeypatch):
    boxes, seen, pairs = some(90), [], squares.box_pairs
    monkeypatch.setattr(overlay, "BLOCK", 4)
    monkeypatch.setattr(squares, "box_pairs", lambda b: seen.append(b.count()) or pairs(b))
    df, _ = boxed(spark, [*boxes, (5000, (3, 3, 3, 9))])
    want = {}
    for (i, a), (j, b) in itertools.combinations(boxes, 2):
        wide, tall = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if wide > 0 and tall > 0:
            want[min(i, j), max(i, j)] = float(wide * tall)
    out = overlay.box_overlaps(df.union(spark.createDataFrame([(6000, None, 0.0, 9.0, 9.0)], df.schema)))
    got = out.collect()
    assert len(got) == len(want) and {(r["first"], r["second"]): r.area for r in got} == want and seen[0] <= 14
    assert out.select(F.spark_partition_id()).distinct().count() > 1
