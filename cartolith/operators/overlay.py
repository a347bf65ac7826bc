"""Overlays: set algebra on cells that belong to owners, and joins of points, boxes and shapes.

A feature is the set of cells (owner, x, y); intersections, differences and unions are equi-joins on (x, y), so a spatial
predicate is never a nested loop. Points meet shapes, and boxes meet boxes, through squares of the size that fits each box.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import squares
from cartolith.session import written

XY = ["x", "y"]
#: Ids of equal boxes that are paired together.
BLOCK = 256


def intersect(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*XY).distinct(), XY, "left_semi")


def subtract(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*XY).distinct(), XY, "left_anti")


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).distinct()


def areas(cells: DataFrame, owner: str = "owner") -> DataFrame:
    return cells.groupBy(owner).agg(F.count(F.lit(1)).alias("area"))


def overlaps(cells: DataFrame, owner: str = "owner", least: int = 1) -> DataFrame:
    """(first, second, area) of owners that share cells, each pair once.

    Cells of one owner alone drop out before the pairs of a cell are formed.
    """
    here = cells.select(*XY, F.col(owner).alias("o")).groupBy(*XY).agg(F.sort_array(F.collect_set("o")).alias("owners")).where(F.size("owners") > 1)
    pair = F.flatten(F.transform("owners", lambda a: F.transform(F.filter("owners", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return here.select(F.explode(pair).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= least)


def similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: areas, intersection, union, IoU and both coverage ratios of two cell sets."""
    both = first.select(*XY, F.lit(1).alias("a")).unionByName(second.select(*XY, F.lit(0).alias("a"))).distinct()
    cell = both.groupBy(*XY).agg(F.max("a").alias("in_first"), (1 - F.min("a")).alias("in_second"))
    n = cell.agg(F.coalesce(F.sum("in_first"), F.lit(0)).alias("first_area"), F.coalesce(F.sum("in_second"), F.lit(0)).alias("second_area"), F.coalesce(F.sum(F.col("in_first") * F.col("in_second")), F.lit(0)).alias("intersection"), F.count(F.lit(1)).alias("union_area"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.lit(1e-12), F.col(b).cast("double"))
    return n.select("*", ratio("intersection", "union_area").alias("iou"), ratio("intersection", "first_area").alias("first_covered"), ratio("intersection", "second_area").alias("second_covered"))


def touching(cells: DataFrame, mask: DataFrame, owner: str = "owner", least: int = 1) -> DataFrame:
    """Owners that share at least so many cells with the mask, with the number."""
    return areas(intersect(cells, mask), owner).where(F.col("area") >= least)


def clip_to_land(countries: DataFrame, borders: DataFrame, land: DataFrame, unclaimed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Countries and borders on land, land that nobody has, and one row of areas; inputs stay as they are.

    countries: owner, x, y; borders: id, x, y (cells on either side of a border); land, unclaimed: x, y.
    """
    shown = intersect(countries, land).withColumn("display_clip", F.lit("authoritative-land-mask"))
    lines = intersect(borders, land)
    free = subtract(subtract(land, countries), unclaimed)
    state = land.select(*XY, F.lit(1).alias("l"), F.lit(0).alias("c"), F.lit(0).alias("u"))
    state = state.union(countries.select(*XY, F.lit(0), F.lit(1), F.lit(0))).union(unclaimed.select(*XY, F.lit(0), F.lit(0), F.lit(1)))
    state = state.groupBy(*XY).agg(F.max("l").alias("l"), F.max("c").alias("c"), F.max("u").alias("u"))
    report = state.agg(
        F.count_if((F.col("l") == 1) & (F.col("c") == 0) & (F.col("u") == 0)).alias("unassigned_land"),
        F.count_if((F.col("l") == 1) & (F.col("u") == 1)).alias("unclaimed_land"),
        F.count_if((F.col("l") == 0) & (F.col("c") == 1)).alias("country_outside_land"),
        F.count_if((F.col("l") == 1) & (F.col("c") == 1)).alias("country_on_land"),
    )
    return shown, lines, free, report


def points_in_shapes(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """points (x, y, ...) joined with the shapes (shape, ...) that hold them, edges included."""
    near = squares.in_boxes(points, shapes.withColumn("box", g.bbox(F.col("shape"))))
    return near.where(g.in_multipolygon(F.col("x"), F.col("y"), F.col("shape"))).drop("box")


def first_holder(points: DataFrame, shapes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, the holder of smallest order) of each point that a shape holds.

    A place is asked for once, however many points are there, and of equal shapes the first one alone can be the holder.
    """
    kinds = shapes.groupBy("shape").agg(F.min_by("id", order).alias("id"), F.min(order).alias("first"))
    held = points_in_shapes(points.select(*XY).distinct(), kinds).groupBy(*XY).agg(F.min_by("id", "first").alias("id"), F.min("first").alias("first"))
    return points.join(held.withColumnRenamed("id", "holder"), XY).groupBy(key).agg(F.min_by("holder", "first").alias("id"))


def exactly_one(points: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(key, id) of each point's only holder; fails where a point has none or several."""
    found = points.select(key).join(points_in_shapes(points, shapes).select(key, "id"), key, "left")
    counted = found.groupBy(key).agg(F.count("id").alias("n"), F.max("id").alias("id"))
    from cartolith.operators.features import checked

    return checked(counted, F.col("n") == 1, F.concat(F.lit("anchor must be in exactly one part: "), F.col(key).cast("string"))).select(key, "id")


def box_overlaps(boxes: DataFrame, least: float = 1e-9) -> DataFrame:
    """(first, second, area) of boxes (id, x0, y0, x1, y1) that overlap by more than `least`, each pair once.

    Equal boxes meet the others as one. Their ids lie in blocks of some BLOCK, and it is pairs of blocks that are dealt over the
    tasks and written out, so that neither a place nor a box that many share is one task's work.
    """
    sides = ["x0", "y0", "x1", "y1"]
    sizes = boxes.groupBy(*sides).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("kind"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    same = functools.reduce(lambda a, b: a & b, (F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in sides))
    ids = boxes.alias("b").join(sizes.alias("s"), same).select("s.kind", "b.id", block.alias("block"))
    blocks = written(ids.groupBy("kind", "block").agg(F.sort_array(F.collect_list("id")).alias("ids")), "box-ids")
    kinds = written(sizes.select(F.col("kind").alias("id"), F.struct(*sides).alias("box")), "box-kinds")
    extent = lambda a, b, c: F.least(f"{a}.{c}1", f"{b}.{c}1") - F.greatest(f"{a}.{c}0", f"{b}.{c}0")
    met = squares.box_pairs(kinds).select("first", "second", extent("a", "b", "x").alias("wide"), extent("a", "b", "y").alias("tall"))
    own = kinds.select(F.col("id").alias("first"), F.col("id").alias("second"), extent("box", "box", "x").alias("wide"), extent("box", "box", "y").alias("tall"))
    met = met.unionByName(own).where("wide > 0 and tall > 0").select("first", "second", (F.col("wide") * F.col("tall")).alias("area")).where(F.col("area") > least)
    left, right = (blocks.select(F.col("kind").alias(k), F.col("block").alias(f"{k}_block"), F.col("ids").alias(f"{k}_ids")) for k in ("first", "second"))
    pairs = met.join(left, "first").join(right, "second").where("first <> second or first_block <= second_block")
    pairs = pairs.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first", "first_block", "second", "second_block")
    each = pairs.select(F.explode("first_ids").alias("p"), "second_ids", "area", ((F.col("first") == F.col("second")) & (F.col("first_block") == F.col("second_block"))).alias("within"))
    each = each.select("p", F.explode("second_ids").alias("q"), "area", "within").where("not within or p < q")
    return each.select(F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), "area")


def nearest(points: DataFrame, targets: DataFrame, within: float, key: str = "key", group: str | None = None) -> DataFrame:
    """(key, id, d2) of the target nearest to each point, closer than `within`; ties to the smaller order.

    A place is asked for once, and of targets at one place the first counts. points: key, x, y; targets: id, ord, x, y; group: a column that both share and that has to match.
    """
    more = [group] if group else []
    place = [*XY, *more]
    asked, keys = points.select(*place).distinct(), points.select(key, *place)
    targets = targets.groupBy(*place).agg(F.min(F.struct("ord", "id")).alias("t")).select(*place, "t.ord", "t.id")
    a = asked.withColumns({"qx": F.floor(F.col("x") / within), "qy": F.floor(F.col("y") / within)})
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("s")
    b = targets.select("id", "ord", *more, F.col("x").alias("tx"), F.col("y").alias("ty"), shift)
    b = b.select("id", "ord", *more, "tx", "ty", (F.floor(F.col("tx") / within) + F.col("s.i")).alias("qx"), (F.floor(F.col("ty") / within) + F.col("s.j")).alias("qy"))
    d2 = g.squared(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    met = a.join(b, ["qx", "qy", *more]).withColumn("d2", d2).where(F.col("d2") < within * within)
    found = met.groupBy(*place).agg(F.min(F.struct("d2", "ord", "id")).alias("m"))
    return keys.join(found, place).groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.id").alias("id"), F.col("m.d2").alias("d2"))


def nearest_in_group(points: DataFrame, targets: DataFrame, group: str, key: str = "key", k: int = 1) -> DataFrame:
    """(key, place, id, d2) of the k targets of a point's group that are nearest; ties to the smaller order, then id.

    A point meets the squares of its group's targets that can hold one of the k, however large the group is.
    """
    return squares.nearest_in_tree(points, targets, group, key, k).select(key, "place", "id", "d2")


def absorb_gaps(cells: DataFrame, territory: DataFrame, reach: int | None = None, owner: str = "owner") -> DataFrame:
    """Owners' cells within a territory, each gap of it (its connected free cells) given whole to the nearest owner.

    Gaps wait for each other: they go by their first cells, row by row, and what an owner has got counts as its own for
    those that come later. Nearest is by the closest pair of cells, ties to the smaller owner. With a reach, gaps farther
    than that from all owners of the start stay free and pass nothing on. Without owners nothing happens.

    Most gaps touch an owner, and nothing is nearer. Others look for the nearest gap before them; such gaps and those that
    they lean on are settled in order, for each connected part of that graph by itself, one row a gap and link.
    """
    from cartolith.operators.grid import AROUND_4, adjacent, components, linked, nearest_seed

    inside = intersect(cells, territory)
    gaps = written(components(subtract(territory, inside)), "gaps")
    seeds = inside.select("x", "y", F.col(owner).alias("label"))
    close = nearest_seed(gaps, seeds, reach).join(gaps, XY)
    direct = written(close.where(F.col("label").isNotNull()).groupBy("component").agg(F.min(F.struct("d2", "label")).alias("m")).select("component", "m.d2", "m.label"), "gap-owners")
    best = direct.select("component", F.col("label").alias(owner))
    alone = direct.where("d2 >= 4").select("component")  # other gaps are two cells away at least
    if not alone.isEmpty():
        mine = gaps.join(direct.select("component"), "component", "left_semi")
        inner = adjacent(mine, AROUND_4, ("component",)).where("component = n_component").groupBy(*XY).count().where("count = 4").select(*XY)
        rim = written(mine.join(inner, XY, "left_anti").select("component", F.col("component").alias("id"), F.col("component").alias("ord"), F.lit(0).alias("all"), *XY), "gap-rims")
        asks = rim.join(alone, "component", "left_semi").select((F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("key"), F.col("component").alias("before"), "all", *XY)
        near = squares.nearest_in_tree(asks, rim.select("id", "ord", "all", *XY), "all", "key", before="before", ties=True)
        near = near.join(asks.select("key", F.col("before").alias("component")), "key").groupBy("component", F.col("id").alias("other")).agg(F.min("d2").alias("gap"))
        least = near.groupBy("component").agg(F.min("gap").alias("gap"))
        near = near.join(least, ["component", "gap"]).join(direct, "component").where("gap <= d2").select("component", "other", "gap")
        near = written(near, "gap-links")
        parts = linked(near.select(F.col("other").alias("u"), F.col("component").alias("v")))
        rows = direct.join(near, "component", "left").join(parts.withColumnRenamed("node", "component"), "component", "left")
        rows = rows.select("component", F.col("d2").cast("double").alias("d2"), "label", "other", "gap", F.coalesce("root", "component").alias("root"))
        roots = near.select(F.col("component").alias("node")).join(parts, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
        leans = written(rows.join(roots, "root", "left_semi"), "gap-parts")
        kind = direct.schema["label"].dataType.simpleString()

        def settle(group: pa.Table) -> pa.Table:
            got: dict[int, object] = {}
            by: dict[int, list[tuple]] = defaultdict(list)
            for component, d2, label, other, gap in zip(*(group.column(c).to_pylist() for c in ("component", "d2", "label", "other", "gap")), strict=True):
                by[component].append((d2, label, other, gap))
            for component in sorted(by):
                options = [(by[component][0][0], by[component][0][1])]
                options += [(gap, got[other]) for _, _, other, gap in by[component] if other is not None]
                got[component] = min(options)[1]
            return pa.table([pa.array(list(got), pa.int64()), pa.array(list(got.values()), group.column("label").type)], ["component", owner])

        settled = leans.groupBy("root").applyInArrow(settle, f"component long, {owner} {kind}")
        best = best.join(leans.select("component"), "component", "left_anti").unionByName(settled)
    return inside.select(owner, *XY).union(gaps.join(best, "component").select(owner, *XY))


def boundary_metrics(first: DataFrame, second: DataFrame, tolerance: int) -> DataFrame:
    """One row: IoU, and shares of either boundary that are within a tolerance of the other, and their F score.

    first, second: x, y, value (0 or 1) over the same grid.
    """
    from cartolith.operators.grid import dilate, gradient

    edges = [gradient(c, "value", 3) for c in (first, second)]
    wide = [dilate(e, "value", tolerance).withColumnRenamed("value", "wide") for e in edges]
    hit = lambda e, w, n: e.where("value = 1").join(w, XY).agg(F.count(F.lit(1)).alias(f"{n}_edge"), F.coalesce(F.sum("wide"), F.lit(0)).alias(f"{n}_hit"))
    one, two = hit(edges[0], wide[1], "first"), hit(edges[1], wide[0], "second")
    same = similarity(first.where("value = 1"), second.where("value = 1")).select("intersection", "union_area")
    row = one.join(two).join(same)  # one row each
    p, r = F.col("first_hit") / F.greatest(F.lit(1), "first_edge"), F.col("second_hit") / F.greatest(F.lit(1), "second_edge")
    return row.select((F.col("intersection") / F.greatest(F.lit(1), "union_area")).alias("iou"), p.alias("boundary_precision"), r.alias("boundary_recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("boundary_f"))
