"""Joins in the plane through squares of several sizes: boxes and points at the level that fits each box, and nearest
targets by descent through a tree of squares.

A square of level l is 2^l wide, and (qx, qy) counts squares from the origin on. Each square lies in one of the next level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.session import written

#: Levels that boxes may have: sides from 2^-20 to 2^50.
LOWEST, HIGHEST = -20, 50


def side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def at(value: Column, level: Column) -> Column:
    """The number of the square of a level that a coordinate lies in."""
    return F.floor(value / side(level)).cast("long")


def fitting(box: Column) -> Column:
    """The least level whose squares are as wide and as high as a box, which then touches four of them at most."""
    longest = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    level = F.when(longest > 0, F.ceil(F.log2(longest))).otherwise(LOWEST)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), level)).cast("int")


def keyed(boxes: DataFrame, levels: Column | None = None) -> DataFrame:
    """boxes (box: x0, y0, x1, y1; level) once for each square that they touch at their level, or at each of `levels`."""
    out = boxes.withColumn("q", F.explode(F.array("level") if levels is None else levels))
    out = out.withColumn("qx", F.explode(F.sequence(at(F.col("box.x0"), F.col("q")), at(F.col("box.x1"), F.col("q")))))
    return out.withColumn("qy", F.explode(F.sequence(at(F.col("box.y0"), F.col("q")), at(F.col("box.y1"), F.col("q")))))


def _levels(boxes: DataFrame) -> list[int]:
    """Levels that occur, a few dozen at most."""
    return sorted(r.level for r in boxes.select("level").distinct().collect())


def _from(level: Column, known: list[int]) -> Column:
    """Of known levels, those from a level on."""
    return F.filter(F.lit(known).cast("array<int>") if known else F.array().cast("array<int>"), lambda x: x >= level)


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(first, second, a, b) of boxes (id, box) that meet, by rising id, each pair once.

    A box waits in the squares of its own level, four at most, and asks in its squares of all levels from its own on
    that have boxes; so a pair meets at the level of the larger one, and is kept in the first square that both touch. No box has
    more than four rows for each level, however large it is.
    """
    placed = written(boxes.select("id", "box", fitting(F.col("box")).alias("level")), "boxes")
    waits = keyed(placed).select("q", "qx", "qy", F.col("id").alias("big"), F.col("box").alias("wide"))
    asks = keyed(placed, _from(F.col("level"), _levels(placed))).select("q", "qx", "qy", F.col("id").alias("small"), F.col("level").alias("own"), F.col("box").alias("narrow"))
    met = asks.join(waits, ["q", "qx", "qy"])
    once = (F.col("qx") == at(F.greatest("wide.x0", "narrow.x0"), F.col("q"))) & (F.col("qy") == at(F.greatest("wide.y0", "narrow.y0"), F.col("q")))
    # of two boxes of one level, each asks; the one of lesser id counts
    met = met.where((F.col("small") != F.col("big")) & once & ((F.col("own") < F.col("q")) | (F.col("small") < F.col("big"))))
    meet = (F.least("wide.x1", "narrow.x1") >= F.greatest("wide.x0", "narrow.x0")) & (F.least("wide.y1", "narrow.y1") >= F.greatest("wide.y0", "narrow.y0"))
    lower = F.col("small") < F.col("big")
    pick = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    return met.where(meet).select(pick("small", "big").alias("first"), pick("big", "small").alias("second"), pick("narrow", "wide").alias("a"), pick("wide", "narrow").alias("b"))


def in_boxes(points: DataFrame, boxed: DataFrame) -> DataFrame:
    """points (x, y, ...) joined with the rows (box, ...) whose box holds them, edges included."""
    placed = written(boxed.withColumn("level", fitting(F.col("box"))), "boxes")
    known = _levels(placed)
    asks = points.withColumn("q", F.explode(F.lit(known).cast("array<int>") if known else F.array().cast("array<int>")))
    asks = asks.withColumns({"qx": at(F.col("x"), F.col("q")), "qy": at(F.col("y"), F.col("q"))})
    met = asks.join(keyed(placed), ["q", "qx", "qy"])
    return met.where(F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1"))).drop("q", "qx", "qy", "level")


#: Targets of a square that isn't divided, and levels of the tree's steps: a square has 4^STEP parts.
LEAF, STEP, DEEPEST = 32, 2, 24
#: So many rows of the tree's level at most are broadcast, about 100 bytes each.
BROADCAST_ROWS = 100_000


def _tree(targets: DataFrame, group: str, level0: int) -> DataFrame:
    """(group, depth, qx, qy, n, low, leaf): squares with targets down to those of LEAF targets; low is the least ord there.

    Depth 0 is a square of level level0; each depth more is STEP levels less, down to DEEPEST depths.
    """
    depth = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("depth")
    level = F.lit(level0) - F.col("depth") * STEP
    every = targets.select(group, "ord", "x", "y", depth).select(group, "ord", "depth", at(F.col("x"), level).alias("qx"), at(F.col("y"), level).alias("qy"))
    nodes = written(every.groupBy(group, "depth", "qx", "qy").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("low")), "squares")
    own = nodes.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("depth") == DEEPEST))
    up = nodes.where(F.col("n") > LEAF).select(group, (F.col("depth") + 1).alias("depth"), F.col("qx").alias("ux"), F.col("qy").alias("uy"))
    part = lambda c: F.shiftright(c, STEP)
    below = own.where("depth > 0").withColumns({"ux": part("qx"), "uy": part("qy")}).join(up, [group, "depth", "ux", "uy"], "left_semi").drop("ux", "uy")
    return written(own.where("depth = 0").unionByName(below), "tree")


def _reach(level: Column, near: bool, slack: float) -> Column:
    """The squared distance from (x, y) to the nearest, or farthest, place of square (qx, qy), less, or more, by a slack for rounding."""
    size = side(level)
    gaps = []
    for c, q in (("x", "qx"), ("y", "qy")):
        low, high = F.col(q) * size - F.col(c), F.col(c) - (F.col(q) + 1) * size
        gaps.append(F.greatest(low - slack, high - slack, F.lit(0.0)) if near else F.greatest(F.abs(low), F.abs(high)) + slack)
    return gaps[0] * gaps[0] + gaps[1] * gaps[1]


def nearest_in_tree(points: DataFrame, targets: DataFrame, group: str, key: str, k: int = 1, before: str | None = None, ties: bool = False) -> DataFrame:
    """(key, place, id, ord, d2) of the k targets of a point's group that are nearest; ties to the smaller order, then id.

    points: key, x, y, group; targets: id, ord, x, y, group. before: a column of points; only targets of lesser ord
    count. With ties, all targets as near as the k-th. Points and targets without a place or group take no part.

    Targets lie in a tree of squares. A point goes down from the largest one: of the squares that it keeps it knows how many
    targets they have, and so a distance within which there are k; parts of squares farther off are dropped. No point
    meets all targets of its group, and none goes through the driver. Of targets at one place the first k count.
    """
    number = {c: F.col(c).cast("double") for c in ("x", "y")}
    sound = F.col(group).isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    a, b = points.withColumns(number).where(sound), targets.withColumns(number).where(sound)
    if not ties and before is None:
        place = Window.partitionBy(group, "x", "y").orderBy("ord", "id")
        b = b.withColumn("p", F.row_number().over(place)).where(F.col("p") <= k).drop("p")
    b = written(b.select(group, "id", "ord", "x", "y"), "targets")
    far = b.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first().m
    limit = [F.col(before).alias("limit")] if before else []
    front = a.select(key, "x", "y", group, *limit)
    if far is None:
        return front.select(key, F.lit(1).alias("place"), F.lit(None).alias("id"), F.lit(None).alias("ord"), F.lit(0.0).alias("d2")).where("false")
    level0 = math.frexp(far)[1] if far else 0  # far < 2^level0
    slack = 2.0**level0 * 1e-13
    tree = _tree(b, group, level0)

    def pruned(rows: DataFrame, depth: int) -> DataFrame:
        """Squares that may hold one of the k nearest: nearer than the distance within which squares have k targets."""
        level = F.lit(level0 - STEP * depth)
        rows = rows.withColumns({"near": _reach(level, True, slack), "far": _reach(level, False, slack)})
        mine = Window.partitionBy(key).orderBy("far", "qx", "qy")
        if before:  # a square has one target of lesser ord for certain
            rows = rows.where(F.col("low") < F.col("limit"))
        counts = F.lit(1) if before else F.col("n")
        rows = rows.withColumn("sum", F.sum(counts).over(mine))
        bound = F.least("was", F.min(F.when(F.col("sum") >= k, F.col("far"))).over(Window.partitionBy(key)))
        return rows.withColumn("bound", bound).drop("was").where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).drop("near", "far", "sum")

    depth, leaves = 0, []
    nodes = tree.where("depth = 0").drop("depth")
    front = front.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, group)  # four squares a group at most
    front = front.withColumn("was", F.lit(None).cast("double"))
    while True:
        front = written(pruned(front, depth), "front")
        leaves.append(front.where("leaf").select(key, "x", "y", group, *(["limit"] if before else []), "qx", "qy", F.lit(depth).alias("depth"), "bound"))
        open_ = front.where("not leaf")
        if open_.isEmpty():
            break
        depth += 1
        parts = tree.where(F.col("depth") == depth).drop("depth").withColumns({"ux": F.shiftright("qx", STEP), "uy": F.shiftright("qy", STEP)})
        parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
        down = open_.drop("n", "low", "leaf").withColumnsRenamed({"qx": "ux", "qy": "uy", "bound": "was"}).join(parts, [group, "ux", "uy"]).drop("ux", "uy")
        near = _reach(F.lit(level0 - STEP * depth), True, slack)
        front = down.where(F.col("was").isNull() | (near <= F.col("was")))
    met = None
    for d, found in enumerate(leaves):
        level = F.lit(level0 - STEP * d)
        there = b.select(group, "id", "ord", F.col("x").alias("tx"), F.col("y").alias("ty"), at(F.col("x"), level).alias("qx"), at(F.col("y"), level).alias("qy"))
        there = there.join(tree.where((F.col("depth") == d) & F.col("leaf")).select(group, "qx", "qy"), [group, "qx", "qy"], "left_semi")
        one = found.join(there, [group, "qx", "qy"])
        one = one.where(F.col("ord") < F.col("limit")) if before else one
        one = one.withColumn("d2", g.squared(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))).select(key, "id", "ord", "d2")
        met = one if met is None else met.unionByName(one)
    order = Window.partitionBy(key).orderBy("d2", "ord", "id")
    if ties:
        return met.withColumns({"place": F.row_number().over(order), "rank": F.rank().over(Window.partitionBy(key).orderBy("d2"))}).where(F.col("rank") <= k).select(key, "place", "id", "ord", "d2")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(key, "place", "id", "ord", "d2")
