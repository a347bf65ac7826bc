"""Points, rings and polygons as Columns. A ring is an array of structs (x, y), closed; a polygon is an array of rings,
its hull first; a multipolygon is an array of polygons. World coordinates run right and down from (0, 0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1925.0, 1080.0
LONGITUDE = 179.999
SPAN = 2 * LONGITUDE
TALL = SPAN * (HEIGHT / WIDTH)
POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"


def clamp(v: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(v, low), high)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def world_to_map(x: Column, y: Column) -> Column:
    """Longitude and latitude of a world point, as a struct (x, y)."""
    down = (clamp(y, 0.0, HEIGHT) / HEIGHT - 0.5) * TALL
    return point(clamp(x, 0.0, WIDTH) / WIDTH * SPAN - LONGITUDE, F.degrees(F.atan(F.sinh(F.radians(-down)))))


def map_to_world(longitude: Column, latitude: Column) -> Column:
    down = -F.degrees(F.log(F.tan(F.lit(math.pi / 4) + F.radians(latitude) / 2)))
    return point(clamp((longitude + LONGITUDE) / SPAN * WIDTH, 0.0, WIDTH), clamp((down / TALL + 0.5) * HEIGHT, 0.0, HEIGHT))


def map_ring(ring: Column, f) -> Column:
    return F.transform(ring, lambda p: f(p["x"], p["y"]))


def map_multipolygon(shape: Column, f) -> Column:
    return F.transform(shape, lambda poly: F.transform(poly, lambda ring: map_ring(ring, f)))


def _pairs(ring: Column) -> Column:
    """Each point of a ring with the next one."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.lit(0), n - 1)).alias("a"), F.slice(ring, F.lit(2), F.greatest(F.lit(0), n - 1)).alias("b"))


def _fold_pairs(ring: Column, start: Column, step) -> Column:
    """step(acc, x0, y0, x1, y1) over a ring's edges."""
    edges = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ring) - 2)), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    edges = F.when(F.size(ring) >= 2, edges).otherwise(F.slice(edges, F.lit(1), F.lit(0)))
    return F.aggregate(edges, start, lambda acc, e: step(acc, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def signed_area(ring: Column) -> Column:
    return 0.5 * _fold_pairs(ring, F.lit(0.0), lambda s, x0, y0, x1, y1: s + x0 * y1 - x1 * y0)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(poly: Column) -> Column:
    """The hull's area less the holes', 0 at least."""
    areas = F.transform(poly, ring_area)
    holes = F.aggregate(F.slice(areas, F.lit(2), F.size(areas)), F.lit(0.0), lambda s, a: s + a)
    return F.greatest(F.lit(0.0), F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - holes)


def area(shape: Column) -> Column:
    return F.aggregate(F.transform(shape, polygon_area), F.lit(0.0), lambda s, a: s + a)


def bbox(shape: Column) -> Column:
    points = F.flatten(F.flatten(shape))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bounds_match(actual: Column, expected: Column, tolerance: float) -> Column:
    return F.forall(F.zip_with(actual, expected, lambda a, b: F.abs(a - b)), lambda d: d <= tolerance)


def alignment(local: Column, world: Column) -> Column:
    """(sx, sy, ox, oy) that takes one box (array of x0, y0, x1, y1) to another."""
    l, w = (lambda i: F.get(local, F.lit(i))), (lambda i: F.get(world, F.lit(i)))
    sx, sy = (w(2) - w(0)) / (l(2) - l(0)), (w(3) - w(1)) / (l(3) - l(1))
    return F.struct(sx.alias("sx"), sy.alias("sy"), (w(0) - l(0) * sx).alias("ox"), (w(1) - l(1) * sy).alias("oy"))


def to_world(x: Column, y: Column, c: Column) -> Column:
    return point(x * c["sx"] + c["ox"], y * c["sy"] + c["oy"])


def to_local(x: Column, y: Column, c: Column) -> Column:
    return point((x - c["ox"]) / c["sx"], (y - c["oy"]) / c["sy"])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test; points on an edge count as inside or outside as the crossing rule has it."""
    crossings = _fold_pairs(ring, F.lit(0), lambda n, x0, y0, x1, y1: n + F.when(((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / F.when(y1 == y0, F.lit(1.0)).otherwise(y1 - y0) + x0), 1).otherwise(0))
    return crossings % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    def touch(hit: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        flat = (x1 - x0) * (y - y0) == (y1 - y0) * (x - x0)
        return hit | (flat & x.between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1)))

    return _fold_pairs(ring, F.lit(False), touch)


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Inside the hull and no hole; edges count as inside."""
    inside = F.aggregate(F.transform(poly, lambda r: in_ring(x, y, r).cast("int")), F.lit(0), lambda s, v: s + v) % 2 == 1
    return inside | F.exists(poly, lambda r: on_ring(x, y, r))


def in_multipolygon(x: Column, y: Column, shape: Column) -> Column:
    return F.exists(shape, lambda poly: in_polygon(x, y, poly))


def squared(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)


def nearest_on_ring(x: Column, y: Column, ring: Column) -> Column:
    """(d2, x, y) of the ring's point that is nearest; the first of several."""
    none = F.struct(F.lit(float("inf")).alias("d2"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(best: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        length = squared(x0, y0, x1, y1)
        t = F.when(length > 0, clamp(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length, 0.0, 1.0)).otherwise(0.0)
        px, py = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        d2 = squared(x, y, px, py)
        return F.when(d2 < best["d2"], F.struct(d2.alias("d2"), px.alias("x"), py.alias("y"))).otherwise(best)

    return _fold_pairs(ring, none, step)


def clamped_inside(x: Column, y: Column, shape: Column) -> Column:
    """The point itself where the shape holds it, else the outline's nearest point."""
    near = F.array_min(F.transform(F.flatten(shape), lambda r: nearest_on_ring(x, y, r)))
    return F.when(in_multipolygon(x, y, shape), point(x, y)).otherwise(point(near["x"], near["y"]))


def box_parameter(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Place on a box's outline: 0 to 1 along the edge y1, then x1, y0 and x0."""
    near = lambda a, b: F.abs(a - b) < 1e-4
    return (
        F.when(near(y, y1), (x - x0) / (x1 - x0))
        .when(near(x, x1), 1 + (y1 - y) / (y1 - y0))
        .when(near(y, y0), 2 + (x1 - x) / (x1 - x0))
        .when(near(x, x0), 3 + (y - y0) / (y1 - y0))
        .otherwise(0.0)
    )


def box_point(t: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    n = F.pmod(t, F.lit(4.0))
    x = F.when(n < 1, x0 + n * (x1 - x0)).when(n < 2, x1).when(n < 3, x1 - (n - 2) * (x1 - x0)).otherwise(x0)
    y = F.when(n < 1, y1).when(n < 2, y1 - (n - 1) * (y1 - y0)).when(n < 3, y0).otherwise(y0 + (n - 3) * (y1 - y0))
    return point(x, y)


def ray_to_box(x: Column, y: Column, dx: Column, dy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where a ray first leaves a box that may or may not hold its start; null if it misses."""

    def hit(d: Column, edge: Column, start: Column, other: Column, do: Column, low: Column, high: Column, flip: bool) -> Column:
        t = (edge - start) / F.when(d != 0, d)
        at = other + do * t
        good = (t > 0) & (at >= low - 1e-4) & (at <= high + 1e-4)
        p = point(edge, clamp(at, low, high)) if flip else point(clamp(at, low, high), edge)
        return F.when(good, F.struct(t.alias("t"), p.alias("p")))

    hits = F.array(
        F.when(dy > 0, hit(dy, y1, y, x, dx, x0, x1, False)),
        F.when(dy < 0, hit(dy, y0, y, x, dx, x0, x1, False)),
        F.when(dx > 0, hit(dx, x1, x, y, dy, y0, y1, True)),
        F.when(dx < 0, hit(dx, x0, x, y, dy, y0, y1, True)),
    )
    return F.array_min(F.array_compact(hits))["p"]


def parts(shape: Column) -> Column:
    """Each polygon of a shape as a shape."""
    return F.transform(shape, lambda p: F.array(p))


def shape_type(shape: Column) -> Column:
    return F.when(F.size(shape) == 1, "Polygon").otherwise("MultiPolygon")


def without_small_parts(shape: Column, least: float) -> Column:
    return F.filter(shape, lambda p: polygon_area(p) >= least)


def outline(shape: Column) -> Column:
    """All rings as lines."""
    return F.flatten(shape)


def ring_counts(shape: Column) -> Column:
    """Rings, holes, vertices, open rings, repeated points and rings without area."""
    rings = F.flatten(shape)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    same = lambda r: _fold_pairs(r, F.lit(0), lambda n, x0, y0, x1, y1: n + ((x0 == x1) & (y0 == y1)).cast("int"))
    is_open = lambda r: ((F.size(r) > 0) & (F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1))).cast("int")
    flat = lambda r: ((F.size(r) < 4) | (ring_area(r) <= 1e-12)).cast("int")
    return F.struct(
        F.size(rings).alias("rings"),
        (F.size(rings) - F.size(shape)).alias("holes"),
        total(F.transform(rings, lambda r: F.size(r))).alias("vertices"),
        total(F.transform(rings, is_open)).alias("open"),
        total(F.transform(rings, same)).alias("repeated"),
        total(F.transform(rings, flat)).alias("flat"),
    )


def scaled_overlay(left: Column, top: Column, width: Column, height: Column, factor: Column) -> Column:
    """An overlay box scaled about its centre, rounded, 10 at least."""
    half_up = lambda v: F.floor(v + 0.5)
    w, h = F.greatest(F.lit(10), half_up(width * factor)), F.greatest(F.lit(10), half_up(height * factor))
    return F.struct(half_up(left + (width - w) / 2).alias("left"), half_up(top + (height - h) / 2).alias("top"), w.alias("width"), h.alias("height"))


def minimum_zoom(width: Column, height: Column) -> Column:
    """Zoom at which the world fills a viewport, less a margin."""
    fit = F.least(F.greatest(width, F.lit(1)) / 512.0, F.greatest(height, F.lit(1)) / (512.0 * (HEIGHT / WIDTH)))
    return F.log2(fit) - 0.45


def interpolated(at: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear through stops, level beyond their ends."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(at < x1, y0 + (at - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(at <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def palette_color(slot: Column, palette: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, palette)), F.when(slot >= 0, slot)), F.lit(palette[0]))
