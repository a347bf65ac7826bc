"""Label grids to shared boundaries: interface segments, arcs, rings, polygons, borders and their report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import text
from cartolith.functions.geometry import RING, ring_area
from cartolith.operators import chains
from cartolith.operators.ranking import numbered
from cartolith.session import written

SEGMENT = "a int, b int, x0 int, y0 int, x1 int, y1 int"
SHAPE = f"array<array<{RING}>>"


def interfaces(labels: DataFrame) -> DataFrame:
    """(a, b, x0, y0, x1, y1): each unit edge between cells of different labels, once, a < b.

    labels: x, y, label. Cells that aren't there count as 0, and so does what lies beyond the grid.
    """
    known = labels.where(F.col("label") != 0).select("x", "y", F.col("label").cast("int").alias("label"))
    sides = F.array(
        *(F.struct(F.lit(kind).alias("kind"), (F.col("x") + dx).alias("ex"), (F.col("y") + dy).alias("ey")) for kind, dx, dy in (("v", 0, 0), ("v", 1, 0), ("h", 0, 0), ("h", 0, 1)))
    )
    edges = known.select("label", F.explode(sides).alias("s")).select("label", "s.*")
    met = edges.groupBy("kind", "ex", "ey").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    met = met.where((F.col("n") == 1) | (F.col("low") != F.col("high")))
    up, right = (F.col("kind") == "v").cast("int"), (F.col("kind") == "h").cast("int")
    return met.select(
        F.when(F.col("n") == 1, 0).otherwise(F.col("low")).alias("a"),
        F.col("high").alias("b"),
        F.col("ex").cast("int").alias("x0"),
        F.col("ey").cast("int").alias("y0"),
        (F.col("ex") + right).cast("int").alias("x1"),
        (F.col("ey") + up).cast("int").alias("y1"),
    )


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a line; its ends stay, and of a closed one the point that is farthest from them."""
    n = len(points)
    if n < 3:
        return points
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        d = q - p
        length = float(d @ d)
        rel = points[a + 1 : b] - p
        if length:
            t = np.clip(rel @ d / length, 0, 1)
            gap = np.hypot(*(rel - t[:, None] * d).T)
        else:
            gap = np.hypot(*rel.T)
        far = int(gap.argmax())
        if gap[far] > tolerance:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def _joined_points(group: pa.Table) -> np.ndarray:
    """The points of a chain's pieces in order; where one ends, the next begins. flip: pieces that are walked backwards."""
    group = group.sort_by([("ahead", "descending")])
    flip = group.column("flip").to_pylist()
    lines = [chains.points_of(p)[:: -1 if f else 1] for p, f in zip(group.column("points"), flip, strict=True)]
    return np.concatenate([lines[0], *(x[1:] for x in lines[1:])])


def _merged(pieces: DataFrame, tolerance: float, few: int) -> DataFrame:
    """(a, b, part, points): pieces of pairs of labels linked to lines and rings, and simplified once.

    pieces: a written table (a, b, piece, closed, points) with the places x0, y0, x1, y1 of its ends, whole numbers. Where two open ends
    of a pair meet (open0, open1), one goes on with the other.
    """
    whole = F.col("closed") | ~(F.col("open0") | F.col("open1"))
    fields = f"a int, b int, ring boolean, points {RING}"

    def alone(batches):
        for batch in batches:
            lines = [simplify(chains.settled(chains.points_of(p)), tolerance) for p in batch.column("points")]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("closed"), chains.lists(lines)], ["a", "b", "ring", "points"])

    made = pieces.where(whole).select("a", "b", "closed", "points").mapInArrow(alone, fields)
    left = pieces.where(~whole)
    if not left.isEmpty():
        side = lambda end: F.struct(F.lit(end).alias("end"), F.col(f"x{end}").alias("vx"), F.col(f"y{end}").alias("vy"), F.col(f"open{end}").alias("open"))
        ends = left.select("a", "b", "piece", F.explode(F.array(side(0), side(1))).alias("s")).select("a", "b", "piece", "s.*")
        met = ends.where("open").groupBy("a", "b", "vx", "vy").agg(F.array_sort(F.collect_list(F.struct("piece", "end"))).alias("two"))
        two = met.where(F.size("two") == 2).select(F.explode(F.array(*(F.struct(F.col("two.piece")[i].alias("piece"), F.col("two.end")[i].alias("end"), F.col("two.piece")[1 - i].alias("to"), F.col("two.end")[1 - i].alias("at")) for i in (0, 1)))).alias("t")).select("t.*")
        # a piece is walked both ways: forwards it is left at its end 1, and a piece that is met at its end 1 is walked backwards
        links = ends.select("piece", "end").join(two, ["piece", "end"], "left")
        links = written(links.select((F.col("piece") * 2 + (F.col("end") == 0).cast("int")).alias("node"), (F.col("to") * 2 + F.col("at")).alias("next")), "arc-links")
        chain = written(chains.ranked(links, few), "arc-ranks")
        forward = chain.groupBy("leader").agg(F.min("node").alias("least")).where("least % 2 = 0").select("leader")  # of two ways, that which takes the least piece forwards
        ring = links.where("next is null").select(F.col("node").alias("leader"), F.lit(False).alias("ring"))
        chain = chain.join(forward, "leader").join(ring, "leader", "left").select(F.shiftright("node", 1).alias("piece"), (F.col("node") % 2 == 1).alias("flip"), "leader", "ahead", F.coalesce("ring", F.lit(True)).alias("ring"))

        def join(group: pa.Table) -> pa.Table:
            line = _joined_points(group)
            ring = group.column("ring")[0].as_py()
            points = chains.lists([simplify(chains.settled(chains.straight(line) if ring else line), tolerance)])
            return pa.table([*(group.column(c).slice(0, 1) for c in ("a", "b", "ring")), points], ["a", "b", "ring", "points"])

        made = made.unionByName(left.select("a", "b", "points", "piece").join(chain, "piece").groupBy("leader").applyInArrow(join, fields))
    ends = [F.element_at("points", i)[c] for i in (1, 2, -1, -2) for c in ("x", "y")]
    placed = numbered(made, ["a", "b", "ring", *ends], "n")
    first = placed.groupBy("a", "b").agg((F.min("n") - 1).alias("base"))
    return placed.join(first, ["a", "b"]).select("a", "b", (F.col("n") - F.col("base")).cast("int").alias("part"), "points")


def arcs(segments: DataFrame, tolerance: float = 0.0, tile: int = chains.TILE, few: int = chains.FEW_LINKS) -> DataFrame:
    """(a, b, part, points): each interface merged to lines and simplified once for both of its sides.

    Lines run between points where other than two segments of a pair meet, from the lesser end on, or are rings. They are
    pieced together over tiles, so that a task holds a pair's segments within one tile, or one line's corners. Parts count from
    1 for each pair, lines before rings.
    """
    placed = segments.withColumns({"tx": F.floor(F.col("x0") / tile), "ty": F.floor(F.col("y0") / tile)})
    pieces = placed.groupBy("a", "b", "tx", "ty").applyInArrow(chains.arc_pieces(tile), chains.ARC_PIECE)
    return _merged(written(pieces.withColumn("piece", F.monotonically_increasing_id()), "arc-pieces"), tolerance, few)


def snapped_arcs(lines: DataFrame, snap: float, tolerance: float = 0.0, few: int = chains.FEW_LINKS) -> DataFrame:
    """(a, b, part, points): lines of pairs that don't come from cells, snapped to a grid of `snap`, merged and simplified once.

    lines: a, b, points. Points go to the nearest place of the grid (halves to the even one); segments that shrink to a point are
    dropped, and those that fall together are one. Lines end where other than two segments of their pair meet, so that lines with
    nearly equal ends become one, and a line is split where another one's point lies on its own. Lines that cross between
    their points aren't split. Null points and lines of one point give nothing.
    """
    put = F.transform("points", lambda p: F.struct(F.rint(p["x"] / snap).cast("long").alias("x"), F.rint(p["y"] / snap).cast("long").alias("y")))
    pair = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("p"), F.get("p", i + 1).alias("q")))
    cut = lines.where(F.size("points") > 1).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), put.alias("p")).select("a", "b", F.explode(pair).alias("s"))
    cut = cut.select("a", "b", F.least("s.p", "s.q").alias("p"), F.greatest("s.p", "s.q").alias("q")).where("p <> q").distinct()
    at = lambda p: F.struct((F.col(f"{p}.x") * snap).alias("x"), (F.col(f"{p}.y") * snap).alias("y"))
    open_ = {"closed": F.lit(False), "open0": F.lit(True), "open1": F.lit(True)}
    pieces = cut.select("a", "b", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"), F.array(at("p"), at("q")).alias("points")).withColumns(open_)
    return _merged(written(pieces.withColumn("piece", F.monotonically_increasing_id()), "snapped"), tolerance, few)


def label_edges(labels: DataFrame) -> DataFrame:
    """(label, x0, y0, x1, y1) of the unit edges around each label's cells, directed so that the cells are on the right hand."""
    known = labels.where(F.col("label") != 0).select("x", "y", F.col("label").cast("int").alias("label"))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    corners = ((x, y, x + 1, y, 0), (x + 1, y, x + 1, y + 1, 1), (x, y + 1, x + 1, y + 1, 2), (x, y, x, y + 1, 3))
    sides = F.array(*(F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), F.lit(way).alias("way")) for a, b, c, d, way in corners))
    edges = known.select("label", F.explode(sides).alias("s")).select("label", "s.*")
    once = edges.groupBy("label", "x0", "y0", "x1", "y1").agg(F.min("way").alias("way"), F.max("way").alias("most")).where("way = most")
    back = F.col("way") > 1
    return once.select("label", *(F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))))


def ring_pieces(labels: DataFrame, tile: int = chains.TILE, few: int = chains.FEW_LINKS) -> tuple[DataFrame, DataFrame]:
    """Outlines of labels at any size: pieces (label, ring, ahead, points) and rings (label, ring, area, parent).

    A ring's pieces follow each other by falling `ahead`. Holes have negative area, and the hull around them as parent; a
    hull is its own. No task holds more than a label's edges within one tile.
    """
    edges = label_edges(labels).withColumns({"tx": F.floor(F.col("x0") / tile), "ty": F.floor(F.col("y0") / tile)})
    pieces = edges.groupBy("label", "tx", "ty").applyInArrow(chains.ring_pieces, chains.RING_PIECE)
    pieces = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "ring-pieces")
    whole = pieces.where("closed").withColumns({"ring": F.col("piece"), "ahead": F.lit(0).cast("long")})
    left = pieces.where("not closed")
    if not left.isEmpty():
        heads = left.select("label", F.col("x0").alias("x1"), F.col("y0").alias("y1"), "want", F.col("piece").alias("next"))
        links = left.select("label", "x1", "y1", "way", "piece").join(heads, ["label", "x1", "y1"]).where(F.col("want").isNull() | (F.col("want") == F.col("way")))
        ranks = chains.ranked(written(links.select(F.col("piece").alias("node"), "next"), "ring-links"), few)
        whole = whole.unionByName(left.join(ranks.select(F.col("node").alias("piece"), F.col("leader").alias("ring"), "ahead"), "piece"))
    whole = written(whole.select("label", "ring", "ahead", "closed", "area", "drop_x", "drop_y", "points"), "rings")
    drop = F.min(F.when(F.col("drop_x").isNotNull(), F.struct(F.col("drop_y").alias("y"), F.col("drop_x").alias("x")))).alias("drop")
    rings = written(whole.groupBy("label", "ring").agg(F.sum("area").alias("area"), drop), "ring-areas")
    return whole.select("label", "ring", "ahead", "closed", "points"), _with_parents(rings, whole, few)


def _with_parents(rings: DataFrame, pieces: DataFrame, few: int) -> DataFrame:
    """rings with the hull around each. Where a label has several hulls and holes, a hole looks left from its topmost cell:
    the run of the label's cells there begins at an edge of that hull, or of another hole in it, which is asked in turn."""
    hulls = rings.where("area > 0").groupBy("label").agg(F.count(F.lit(1)).alias("hulls"), F.min("ring").alias("only"))
    known = rings.join(hulls, "label")
    simple = known.select("label", "ring", "area", F.when(F.col("area") > 0, F.col("ring")).when(F.col("hulls") == 1, F.col("only")).alias("parent"), "drop")
    asked = written(simple.where("parent is null").select("label", "ring", "area", "drop"), "holes")
    if asked.isEmpty():
        return simple.select("label", "ring", "area", "parent")
    rows = asked.select("label", F.col("drop.y").alias("y")).distinct()
    pair = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("p"), F.element_at("points", i + 1).alias("q")))
    up = pieces.join(asked.select("label").distinct(), "label", "left_semi").select("label", "ring", F.explode(pair).alias("e")).where("e.p.y > e.q.y")
    up = up.select("label", "ring", F.col("e.p.x").cast("long").alias("x"), F.explode(F.sequence(F.col("e.q.y").cast("long"), F.col("e.p.y").cast("long") - 1)).alias("y"))
    spots = up.join(rows, ["label", "y"], "left_semi").select("label", "y", "x", F.col("ring").alias("edge"), F.lit(None).cast("long").alias("hole"))
    spots = spots.unionByName(asked.select("label", "drop.y", "drop.x", F.lit(None).cast("long").alias("edge"), F.col("ring").alias("hole")))
    left = F.last("edge", ignorenulls=True).over(Window.partitionBy("label", "y").orderBy("x", F.col("hole").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    holes = spots.withColumn("next", left).where("hole is not null").select(F.col("hole").alias("node"), "next")
    ends = rings.where("area > 0").join(asked.select("label").distinct(), "label", "left_semi").select(F.col("ring").alias("node"), F.lit(None).cast("long").alias("next"))
    found = chains.ranked(written(holes.unionByName(ends), "hole-links"), few).select(F.col("node").alias("ring"), F.col("leader").alias("parent"))
    return simple.where("parent is not null").select("label", "ring", "area", "parent").unionByName(asked.select("label", "ring", "area").join(found, "ring"))


def outline_rings(labels: DataFrame, tile: int = chains.TILE, few: int = chains.FEW_LINKS) -> DataFrame:
    """(label, parent, hole, at, low, points): outlines of each label's cells, a row a ring, however many rings a label has.

    Rings are pieced together over tiles. parent: the hull around a hole, a hull's own number else; at: a ring's first point; low: its
    topmost and its leftmost place. Cells that repeat count once.
    """
    pieces, rings = ring_pieces(labels, tile, few)

    def join(group: pa.Table) -> pa.Table:
        line = chains.straight(_joined_points(group))
        return pa.table([group.column("ring").slice(0, 1), chains.lists([line])], ["ring", "points"])

    several = pieces.where("not closed").withColumn("flip", F.lit(False)).groupBy("ring").applyInArrow(join, f"ring long, points {RING}")
    lines = pieces.where("closed").select("ring", "points").unionByName(several).join(rings, "ring")
    low = lambda c: F.array_min(F.transform("points", lambda p: p[c]))
    return lines.select("label", "parent", (F.col("area") < 0).alias("hole"), F.col("points")[0].alias("at"), F.struct(low("y").alias("y"), low("x").alias("x")).alias("low"), "points")


def assembled(rings: DataFrame) -> DataFrame:
    """(label, shape) of rings as outline_rings() has them: polygons by the topmost and leftmost places of their hulls, holes by their
    first points. A shape is one value."""
    inner = F.struct("hole", F.col("at").alias("p"), "points")
    whole = rings.groupBy("label", "parent").agg(F.max(F.when(~F.col("hole"), F.col("low"))).alias("place"), F.array_sort(F.collect_list(inner)).alias("r"))
    polygon = F.struct("place", F.col("r")[0]["p"].alias("p"), F.transform("r", lambda r: r["points"]).alias("rings"))
    return whole.groupBy("label").agg(F.array_sort(F.collect_list(polygon)).alias("s")).select("label", F.transform("s", lambda s: s["rings"]).cast(SHAPE).alias("shape"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """(label, area): areas of polygons less those of their holes, of rings that are never put together."""
    each = rings.select("label", "parent", F.when(F.col("hole"), -1).otherwise(1).alias("sign"), ring_area(F.col("points")).alias("area"))
    polygon = each.groupBy("label", "parent").agg(F.greatest(F.lit(0.0), F.sum(F.col("sign") * F.col("area"))).alias("area"))
    return polygon.groupBy("label").agg(F.sum("area").alias("area"))


def polygons(labels: DataFrame, tile: int = chains.TILE, few: int = chains.FEW_LINKS) -> DataFrame:
    """(label, shape): the exact outline of each label's cells, holes with it, islands as polygons of their own.

    A shape is one value; outline_rings() has outlines without such values. Polygons go by their topmost and leftmost places,
    holes by their least points. Cells that repeat count once.
    """
    return assembled(outline_rings(labels, tile, few))


def borders(lines: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Borders between countries, coastlines (the other side is 0), and numbered vertices. ids: label, id."""
    left, right = ids.select(F.col("label").alias("a"), F.col("id").alias("left_id")), ids.select(F.col("label").alias("b"), F.col("id").alias("right_id"))
    named = lines.join(right, "b").join(left, "a", "left")
    short = lambda c: text.without_prefix(F.col(c), "country-")
    part = text.padded(F.col("part"), 4)
    inner = named.where("a <> 0").select(F.concat(F.lit("border-"), short("left_id"), F.lit("-"), short("right_id"), F.lit("-"), part).alias("id"), F.lit("international").alias("type"), "left_id", "right_id", "points")
    coast = named.where("a = 0").select(F.concat(F.lit("coast-"), short("right_id"), F.lit("-"), part).alias("id"), F.lit("coastline").alias("type"), F.col("right_id").alias("country_id"), "points")
    spots = lines.select(F.explode("points").alias("p"), F.when(F.col("a") == 0, "coastline").otherwise("international").alias("type")).select("p.x", "p.y", "type").distinct()
    vertices = numbered(spots, ["x", "y", "type"]).select(F.concat(F.lit("vertex-"), text.padded(F.col("n"), 6)).alias("id"), "type", "x", "y")
    return inner, coast, vertices


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def contour_rings(labels: DataFrame, tolerance: float, least_area: float = 1.0) -> DataFrame:
    """outline_rings() simplified one by one; those that would vanish become their bounding boxes."""

    def thin(points: np.ndarray) -> np.ndarray:
        slim = simplify(points, tolerance)
        if len(slim) < 4 or abs(_area(slim)) < least_area:
            (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
            slim = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
        return slim

    def run(batches):
        for batch in batches:
            slim = chains.lists([thin(chains.points_of(p)) for p in batch.column("points")])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], slim], batch.schema.names)

    point = "struct<x:double,y:double>"
    return outline_rings(labels).mapInArrow(run, f"label int, parent long, hole boolean, at {point}, low struct<y:double,x:double>, points {RING}")


def contours(labels: DataFrame, tolerance: float, least_area: float = 1.0) -> DataFrame:
    """(label, shape) of outlines simplified one by one; parts that would vanish become their bounding boxes.

    Unlike arcs(), neighbours are simplified apart and may overlap; meant for comparison. A shape is one value; contour_rings()
    has a row a ring.
    """
    return assembled(contour_rings(labels, tolerance, least_area))
