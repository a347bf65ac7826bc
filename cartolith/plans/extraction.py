"""Whole extractions: fills, countries, land, regions, labels and placements, as plans over cell tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import colors, text
from cartolith.operators import features as ft
from cartolith.operators import fits, grid, overlay, ranking, sealing, shapes, topology, validate
from cartolith.operators.overlay import XY
from cartolith.session import written


def with_states(pixels: DataFrame, land: DataFrame) -> DataFrame:
    """pixels (x, y, r, g, b, a) with `land` and the six mask states."""
    joined = pixels.join(land.select(*XY, (F.col("land") == 1).alias("land")), XY)
    return joined.withColumns(colors.mask_states())


def largest_by_color(cells: DataFrame) -> DataFrame:
    """(r, g, b, largest): cells of each colour's largest component."""
    shade = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    labelled = cells.join(grid.components(cells.withColumn("shade", shade), by="shade"), XY)
    return labelled.groupBy("r", "g", "b", "component").count().groupBy("r", "g", "b").agg(F.max("count").alias("largest"))


def country_labels(states: DataFrame, known: DataFrame, least: int, opaque: float) -> DataFrame:
    """(x, y, id) of foreground cells: palette colours keep their country, edge pixels join the nearest palette cell."""
    front = states.where("not (a < 1 or (r = 0 and g = 0 and b = 0) or (r = 128 and g = 128 and b = 128))")
    found = ft.ids_of_colors(ft.palette(front, least, opaque, largest_by_color(front)), known)
    seeds = front.join(found.select("r", "g", "b", "id"), ["r", "g", "b"]).select(*XY, F.col("id").alias("label"))
    rest = overlay.subtract(front, seeds).select(*XY)
    near = grid.nearest_seed(rest, seeds).where(F.col("label").isNotNull()).select(*XY, "label")
    return seeds.union(near).select(*XY, F.col("label").alias("id"))


@dataclass
class Fill:
    cells: DataFrame
    report: DataFrame
    unresolved: DataFrame
    seedless: DataFrame


def fill_countries(states: DataFrame, labels: DataFrame, islands: DataFrame | None = None, mode: str = "safe", most: int = 12) -> Fill:
    """Unknown land given to the country that reaches it first over walkable land.

    labels: x, y, label (int, above 0); islands: x, y, label for components without any seed. mode: analyze fills nothing,
    safe what is at most `most` steps away, full all that is reached.
    """
    walkable = states.where("land and not unclaimed").select(*XY, "unknown_land").join(labels, XY, "left").withColumn("seed", F.coalesce("label", F.lit(0)))
    parts = written(grid.components(walkable), "walkable")
    placed = written(walkable.join(parts, XY), "placed")
    seeds = placed.groupBy("component").agg(F.count_if(F.col("seed") > 0).alias("seeds"))
    if islands is not None:
        hit = islands.join(placed, XY, "left").select(*XY, "component", "unknown_land", islands["label"].alias("given")).join(seeds, "component", "left")
        hit = ft.checked(hit, F.col("unknown_land") & (F.col("seeds") == 0), "an island's anchor must be on unknown land of a part without seeds")
        once = hit.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("given").alias("given"))
        once = ft.checked(once, F.col("n") == 1, "two anchors on one island")
        placed = placed.join(once.select("component", "given"), "component", "left").withColumn("seed", F.coalesce("given", "seed")).drop("given")
        seeds = placed.groupBy("component").agg(F.count_if(F.col("seed") > 0).alias("seeds"))
    seedless = grid.component_stats(parts).join(seeds.where("seeds = 0").select("component"), "component", "left_semi")
    reached = written(grid.flood(placed.select(*XY, "seed")), "reached").join(placed.select(*XY, "unknown_land", "seed"), XY)
    take = {"analyze": F.lit(False), "safe": F.col("distance").between(0, most), "full": F.col("distance") >= 0}[mode]
    cells = written(reached.select(*XY, "unknown_land", "distance", F.when(~F.col("unknown_land"), F.col("seed")).when(take, F.col("label")).otherwise(0).alias("label")), "filled")
    missing = cells.where("unknown_land")
    steps = ranking.upper_percentiles(missing.where("distance >= 0"), "distance")
    counts = missing.agg(
        F.count(F.lit(1)).alias("missing"),
        F.count_if(F.col("distance") >= 0).alias("reachable"),
        F.count_if(F.col("label") > 0).alias("filled"),
        F.count_if(F.col("label") == 0).alias("unresolved"),
        *(F.count_if(F.col("distance").between(0, t)).alias(f"within_{t}") for t in (4, 8, 16, 32, 42, 61, 79)),
    )
    left = missing.where("label = 0")
    regions = grid.component_stats(grid.components(left).join(left.select(*XY, "distance"), XY), (F.max(F.when(F.col("distance") >= 0, F.col("distance"))).alias("farthest"),))
    regions = regions.withColumn("cause", F.when(F.col("farthest").isNull(), "seedless-land-component").otherwise("beyond-safe-distance"))
    return Fill(cells, counts.join(steps), regions, seedless)  # one row each


@dataclass
class Countries:
    rings: DataFrame
    shapes: DataFrame
    rows: DataFrame
    arcs: DataFrame
    borders: DataFrame
    coast: DataFrame
    vertices: DataFrame


def country_products(labels: DataFrame, palette_ids: DataFrame, tolerance: float) -> Countries:
    """Rings, shapes, feature rows, shared arcs, borders, coast and vertices. labels: x, y, label; palette_ids: label, id, r, g, b."""
    rings = written(topology.outline_rings(labels), "outlines")
    made = topology.assembled(rings)
    lines = written(topology.arcs(topology.interfaces(labels), tolerance), "arcs")
    inner, coast, vertices = topology.borders(lines, palette_ids.select("label", "id"))
    return Countries(rings, made, ft.country_rows(made, palette_ids), lines, inner, coast, vertices)


def topology_report(rings: DataFrame, labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: ring figures, components, shared pairs, cells and vector area. rings: as outline_rings() has them, a row each."""
    from cartolith.functions import geometry as g

    each = rings.select("hole", g.ring_counts(F.array(F.array("points"))).alias("r"))
    sums = {n: F.sum(f"r.{n}") for n in ("rings", "vertices", "open", "repeated", "flat")} | {"holes": F.count_if("hole"), "components": F.count_if(~F.col("hole"))}
    names = ("rings", "holes", "vertices", "open", "repeated", "flat", "components")
    one = each.agg(*(F.coalesce(sums[n], F.lit(0)).alias(n) for n in names)).join(topology.ring_areas(rings).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("vector_area")))
    pairs = arcs.where("a > 0").select("a", "b").distinct().agg(F.count(F.lit(1)).alias("shared_pairs"))
    cells = labels.where("label > 0").agg(F.count(F.lit(1)).alias("cells"))
    return one.join(pairs).join(cells).withColumn("area_delta", F.col("vector_area") - F.col("cells"))  # one row each


def land_products(land: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Shapes and coast arcs of land cells."""
    rings, coast = land_lines(land, tolerance)
    return topology.assembled(rings), coast


def land_lines(land: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Rings, a row each, and coast arcs of land cells."""
    labels = land.select(*XY, F.lit(1).alias("label"))
    return topology.outline_rings(labels), topology.arcs(topology.interfaces(labels), tolerance)


def unclaimed_product(cells: DataFrame) -> DataFrame:
    """The one unclaimed feature, or none."""
    made = topology.polygons(cells.select(*XY, F.lit(1).alias("label")))
    return made.select(F.lit("unclaimed-001").alias("id"), F.lit("unclaimed").alias("type"), F.array(*(F.lit(v) for v in colors.UNCLAIMED)).alias("rgb"), F.size("shape").alias("polygon_count"), (F.size(F.flatten("shape")) - F.size("shape")).alias("hole_count"), "shape")


def silhouette(pixels: DataFrame, threshold: int, kernel: int, least: int) -> DataFrame:
    """Land of a drawn map: red above blue, closed, without small parts."""
    value = pixels.select(*XY, colors.land_by_red_minus_blue(threshold).cast("int").alias("value"))
    return grid.keep_large(grid.close(value, "value", kernel).where("value = 1"), least)


def faces(barrier: DataFrame, x0: int, y0: int, x1: int, y1: int, least: int) -> DataFrame:
    """(x, y, face): areas that lines close off, numbered by their centres from the top. barrier: x, y of line cells."""
    box = grid.box_cells(barrier.sparkSession, x0, y0, x1, y1)
    free = overlay.subtract(box, barrier)
    closed = grid.components(grid.enclosed(free, x0, y0, x1, y1), grid.AROUND_4)
    stats = grid.component_stats(closed).where(F.col("area") >= least)
    order = ranking.numbered(stats.select("component", "cy", "cx"), ["cy", "cx", "component"], "face")
    return closed.join(order.select("component", "face"), "component").select(*XY, F.col("face").cast("int").alias("face"))


def seeded_faces(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(face, region) of seed cells (x, y, region); fails at seeds outside faces and at faces of two regions."""
    hit = ft.checked(seeds.join(found, XY, "left"), F.col("face").isNotNull(), "a seed is in no face")
    each = hit.groupBy("face").agg(F.min("region").alias("region"), F.max("region").alias("other"))
    return ft.checked(each, F.col("region") == F.col("other"), "a face has seeds of two regions").select("face", "region")


def linework_regions(barrier: DataFrame, seeds: DataFrame, box: tuple[int, int, int, int], least: int, close: int = 1) -> DataFrame:
    """(x, y, region): all cells that lines enclose, lines included, given to the nearest face with a seed.

    barrier: x, y of line cells, closed by a square of `close` cells first; seeds: x, y, region; box: x0, y0, x1, y1 of
    the drawing. What is outside is what can be reached, side by side and free of lines, from the drawing's edge. Faces
    of fewer than `least` cells, and those without a seed, are given away like lines.
    """
    whole = written(grid.box_cells(barrier.sparkSession, *box), "box")
    if close > 1:
        drawn = whole.join(barrier.select(*XY).distinct().withColumn("value", F.lit(1)), XY, "left").fillna(0, ["value"])
        barrier = written(grid.close(drawn, "value", close).where("value = 1").select(*XY), "barrier")
    found = written(faces(barrier, *box, least), "faces")
    chosen = written(seeded_faces(found, seeds), "seeded")  # by itself, so that no join's condition gets ahead of its checks
    named = written(found.join(chosen, "face").select(*XY, "region"), "named")
    inner = grid.enclosed(overlay.subtract(whole, barrier), *box).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    inside = inner.union(overlay.intersect(barrier, whole).select(*XY)).distinct()
    near = grid.nearest_seed(overlay.subtract(inside, named), named.select(*XY, F.col("region").alias("label")))
    return named.union(near.where(F.col("label").isNotNull()).select(*XY, F.col("label").alias("region")))


def mask_regions(pixels: DataFrame, known: DataFrame, parent: DataFrame) -> DataFrame:
    """(owner, x, y) of a categorical mask's colours within a parent's cells. known: rgb, id."""
    front = pixels.where(~colors.is_ocean())
    found = ft.ids_of_colors(front.select("r", "g", "b").distinct(), known)
    return overlay.intersect(front.join(found.select("r", "g", "b", "id"), ["r", "g", "b"]).select(F.col("id").alias("owner"), *XY), parent)


def region_rows(cells: DataFrame, country: str) -> DataFrame:
    """Feature rows of region cells (owner, x, y): numbers, terciles of area, style."""
    sized = overlay.areas(cells).withColumn("number", text.id_number(F.col("owner"), "region-"))
    ranked = ranking.tercile_ranks(sized.withColumn("country_id", F.lit(country)), ["country_id"], "area", "number")
    return ranked.select(F.col("owner").alias("id"), "country_id", "number", "area", F.col("rank").alias("label_rank"), text.style_index(F.col("number"), 5).alias("style_index"))


def place_regions(cells: DataFrame, territory: DataFrame, low: float, high: float, step: float, pad: int) -> tuple[DataFrame, DataFrame]:
    """Region cells moved by the best uniform fit of their union to a territory, and that fit."""
    fit = written(fits.best_fit(cells.select(*XY).distinct(), territory, low, high, step, pad), "fit")
    f = fit.first()
    box = territory.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    target = grid.box_cells(cells.sparkSession, box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad)
    back = target.select(*XY, F.floor((F.col("x") + 0.5 - f.ox) / f.scale).cast("int").alias("sx"), F.floor((F.col("y") + 0.5 - f.oy) / f.scale).cast("int").alias("sy"))
    moved = back.join(cells.select("owner", F.col("x").alias("sx"), F.col("y").alias("sy")), ["sx", "sy"]).select("owner", *XY)
    return moved, fit


def production_labels(made: DataFrame, rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Label points of countries: the given point, which must be inside one part, or the largest part's deepest one.

    made: id, shape; rows: id, name, state_group_id, area; overrides: id, x, y.
    """
    ft.checked(ft.same_keys(made, rows, "id"), F.lit(False), "names and countries differ").count()
    parts = made.select("id", F.posexplode("shape").alias("part", "p")).select(F.concat_ws("/", "id", "part").alias("id"), F.col("id").alias("country"), F.array("p").alias("shape"))
    anchors = overrides.select(F.col("id").alias("key"), "x", "y")
    held = overlay.points_in_shapes(anchors, parts).where("country = key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    given = ft.checked(anchors.join(held, "key", "left"), F.col("n") == 1, "an override must be inside exactly one part").select(F.col("key").alias("id"), "x", "y")
    spots = ft.overridden(shapes.inner_points(made), given, "id", ["x", "y"])
    states = ft.state_areas(rows).select(F.col("state").alias("s"), F.col("area").alias("state_area"), "rank")
    named = spots.join(rows, "id").join(states, F.coalesce("state_group_id", "id") == F.col("s"))
    return named.select(F.concat("id", F.lit("-production-label")).alias("id"), F.col("id").alias("country_id"), "name", "x", "y", F.col("rank").alias("label_rank"), F.col("state_area").alias("area_world"), F.when(F.col("overridden"), "manual-override").otherwise("largest-component-polylabel").alias("method"))


def debug_labels(made: DataFrame) -> DataFrame:
    """(id, label, parts, share, questionable, x, y): each country's short id at its largest part."""
    from cartolith.functions import geometry as g

    parts = made.select("id", F.posexplode("shape").alias("part", "p")).select("id", "part", g.polygon_area(F.col("p")).alias("area"))
    spots = shapes.inner_points(made)
    return ft.component_choice(parts).join(spots, "id").select("id", text.without_prefix(F.col("id"), "country-").alias("label"), "parts", "share", "questionable", "x", "y")


def photo_cells(owned: DataFrame, pixels: DataFrame, box: tuple[float, float, float, float], size: tuple[int, int], scale: tuple[float, float], shift: tuple[float, float], dark: Column, strokes: DataFrame | None = None) -> DataFrame:
    """(owner, x, y, value) of owners' cells under a photo: -1 where it is dark or a stroke was drawn, else 0."""
    value = grid.sampled_image(owned.select(*XY).distinct(), pixels, box, size, scale, shift, dark)
    value = value if strokes is None else grid.barrier_cells(value, strokes)
    return owned.select("owner", *XY).join(value, XY)


def photo_regions(cells: DataFrame, least: int) -> DataFrame:
    """(owner, x, y, label): regions between the border cells (-1) of each owner's land (0).

    Leaks and gaps are sealed, faces labelled, borders given to the face that reaches them first, noise merged. For the
    search of faces and the fill, owners lie in one grid side by side, a column apart, so that all are done at once.
    """
    sealed = written(sealing.sealed(cells), "sealed")
    bounds = sealed.groupBy("owner").agg(F.min("x").alias("x0"), (F.max("x") - F.min("x") + 2).alias("width"))
    order = ranking.numbered(bounds, ["owner"], "k")
    left = F.coalesce(F.sum("width").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row an owner
    placed = written(sealed.join(order.withColumn("at", left).select("owner", (F.col("at") - F.col("x0")).alias("move")), "owner").withColumn("gx", F.col("x") + F.col("move")), "placed")
    spots = placed.select("owner", F.col("gx").alias("x"), "y", "value", "move")
    parts = grid.components(spots.where("value = 0"), grid.AROUND_4)
    faces_ = parts.select("component").distinct().join(spots.select("owner", (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("component")), "component")
    number = F.row_number().over(Window.partitionBy("owner").orderBy("component"))  # a row a face
    seeds = parts.join(faces_.withColumn("label", number), "component").select(*XY, "label")
    full = spots.join(seeds, XY, "left").select("owner", *XY, "move", F.coalesce("label", F.lit(0)).alias("seed"))
    grown = grid.flood(full.select(*XY, "seed"), grid.AROUND_4).join(full.select("owner", *XY, "move"), XY)
    back = grown.select("owner", (F.col("x") - F.col("move")).cast("int").alias("x"), "y", "label")
    return sealing.without_noise(back, least)


def border_preview(cells: DataFrame) -> DataFrame:
    """(owner, n): border cells after leaks, but not gaps, are sealed."""
    return sealing.sealed(cells, gaps=False).where("value = -1").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


def annotated_mask(pixels: DataFrame, fill: colors.Rgb, tolerance: int, least: int) -> DataFrame:
    """(x, y, component): areas of one drawn colour without the boundaries drawn into them, holes filled, small ones gone."""
    land = pixels.where((colors.chebyshev(fill) <= tolerance) | colors.is_teal_boundary())
    whole = grid.fill_holes(land)
    inner = overlay.subtract(whole, pixels.where(colors.is_teal_boundary()))
    labelled = grid.components(inner, grid.AROUND_4)
    big = grid.component_stats(labelled).where(F.col("area") >= least).select("component")
    return labelled.join(big, "component", "left_semi").select(*XY, "component")


def drawn_mask(pixels: DataFrame, weights: list[float], contrast: float, threshold: int, kernel: int, least_land: int, which: int, least_face: int) -> DataFrame:
    """(x, y, face): faces between dark lines within the which-th largest land part."""
    land = grid.components(silhouette(pixels, threshold, kernel, least_land))
    chosen = ranking.kth_largest(grid.component_stats(land), which, "area", "component").select("component")
    mine = land.join(chosen, "component", "left_semi").select(*XY)
    gray = pixels.join(mine, XY).select(*XY, colors.luma().alias("gray"))
    dark = grid.local_contrast(gray, "gray", weights, contrast).where("dark").select(*XY)
    parts = grid.components(overlay.subtract(mine, dark), grid.AROUND_4)
    stats = grid.component_stats(parts).where(F.col("area") >= least_face)
    order = ranking.numbered(stats.select("component", "cy", "cx"), ["cy", "cx", "component"], "face")
    return parts.join(order.select("component", "face"), "component").select(*XY, F.col("face").cast("int").alias("face"))


def transfer_pixels(mask: DataFrame, area: DataFrame, donor: colors.Rgb, receiver: colors.Rgb, cutoff: int = 3200, most_foreign: int = 32, share: float = 0.08) -> DataFrame:
    """mask with an area's donor pixels in the receiver's colour; fails if too many of its pixels are of other colours."""
    inside = mask.join(area.select(*XY).distinct(), XY, "left_semi")
    kind = colors.nearer_of(donor, receiver, cutoff)
    seen = inside.agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == 0).alias("foreign"))
    ft.checked(seen, (F.col("foreign") <= most_foreign) & (F.col("foreign") <= F.col("n") * share), "the area holds too many foreign pixels").count()
    here = area.select(*XY, F.lit(True).alias("here")).distinct()
    hit = F.coalesce("here", F.lit(False)) & (kind == 1)
    return mask.join(here, XY, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in zip("rgb", receiver, strict=True)}).drop("here")


def foreign_colors(mask: DataFrame, area: DataFrame, donor: colors.Rgb, receiver: colors.Rgb, cutoff: int = 3200) -> DataFrame:
    """The eight commonest other colours of an area."""
    inside = mask.join(area.select(*XY).distinct(), XY, "left_semi").where(colors.nearer_of(donor, receiver, cutoff) == 0)
    return inside.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "r", "g", "b").limit(8)


def correct_component(mask: DataFrame, color: colors.Rgb, anchor: tuple[int, int], box: tuple[int, int, int, int], target: colors.Rgb) -> DataFrame:
    """mask with the component under an anchor recoloured; its colour and its exact bounding box are insisted on."""
    parts = grid.components(mask.where(colors.is_color(color)))
    here = parts.where((F.col("x") == anchor[0]) & (F.col("y") == anchor[1])).select("component")
    mine = parts.join(here, "component", "left_semi")
    seen = mine.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toDF("x0", "y0", "x1", "y1")
    ft.checked(seen, (F.col("x0") == box[0]) & (F.col("y0") == box[1]) & (F.col("x1") == box[2]) & (F.col("y1") == box[3]), "the component's box isn't the reviewed one").count()
    hit = mine.select(*XY, F.lit(True).alias("here"))
    return mask.join(hit, XY, "left").withColumns({c: F.when(F.col("here"), v).otherwise(F.col(c)) for c, v in zip("rgb", target, strict=True)}).drop("here")


def region_report(cells: DataFrame, territory: DataFrame) -> DataFrame:
    """One row: how region cells and a territory fit, and what regions share."""
    fit = overlay.similarity(cells.select(*XY), territory.select(*XY))
    shared = overlay.overlaps(cells).agg(F.coalesce(F.sum("area"), F.lit(0)).alias("overlap_area"))
    return fit.join(shared)  # one row each


@dataclass
class Regions:
    cells: DataFrame
    rows: DataFrame
    shapes: DataFrame
    labels: DataFrame
    borders: DataFrame
    report: DataFrame


def _regions(cells: DataFrame, country: str, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, shapes, labels and shared borders of region cells (owner, x, y); owners end in region-<number>."""
    from cartolith.functions import geometry as g

    labels = written(cells.select(*XY, text.id_number(F.col("owner"), "region-").alias("label")), "labels")
    names = cells.select("owner", text.id_number(F.col("owner"), "region-").alias("label")).distinct()
    made = topology.polygons(labels).join(names, "label").select(F.col("owner").alias("id"), "shape")
    made = written(made, "shapes")
    spots = shapes.inner_points(made).join(made, "id").withColumn("inside", g.in_multipolygon(F.col("x"), F.col("y"), F.col("shape"))).drop("shape")
    lines = topology.arcs(topology.interfaces(labels), tolerance).where("a > 0")
    return region_rows(cells, country), made, spots, lines


def _fit(cells: DataFrame, made: DataFrame, spots: DataFrame, territory: DataFrame, overseas: DataFrame, others: DataFrame) -> DataFrame:
    """One row: how regions lie in their territory, and what they must not meet."""
    from cartolith.functions import geometry as g

    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    fit = overlay.similarity(cells.select(*XY), territory).select(F.col("first_covered").alias("inside_ratio"), F.col("iou").alias("contour_iou"))
    row = fit.join(count(overlay.intersect(cells, overseas), "overseas_area")).join(count(overlay.intersect(cells, others), "wrong_country_area")).join(count(spots.where("not inside"), "labels_outside"))
    ratio = made.agg(F.sum(g.area(F.col("shape"))).alias("vector")).join(count(cells, "n")).select((F.col("vector") / F.greatest(F.lit(1), "n")).alias("area_ratio"))
    shared = overlay.overlaps(cells).agg(F.coalesce(F.sum("area"), F.lit(0)).alias("overlap_area"))
    return row.join(ratio).join(shared)  # one row each


def extract_linework(barrier: DataFrame, seeds: DataFrame, box: tuple[int, int, int, int], least: int, close: int, country: str, territory: DataFrame, overseas: DataFrame, others: DataFrame, required: list[tuple[int, int]] = (), clip: bool = True, tolerance: float = 0.55, closures: list[tuple[int, int]] = (), extensions: list[tuple[int, int]] = (), most: float = 8.0) -> Regions:
    """Regions of a drawing, from its lines to feature rows, borders and the report that linework_gate() judges.

    seeds: x, y, region (a number); territory, overseas, others: x, y of the country's parts that belong to the drawing,
    of its other parts, and of countries that must not be met; required: pairs of numbers that must share a border, where
    a repaired one counts; closures, extensions, most: as repaired() has them.
    """
    spark = barrier.sparkSession
    found = linework_regions(barrier, seeds, box, least, close)
    raw = written(found.select(F.concat(F.lit(f"{country}-region-"), text.padded(F.col("region"), 3)).alias("owner"), *XY), "regions")
    cells = written(overlay.intersect(raw, territory).select("owner", *XY), "clipped") if clip else raw
    rows, made, spots, lines = _regions(cells, country, tolerance)
    lines = written(repaired(written(lines, "lines"), made, territory, country, closures, extensions, most), "borders")
    pairs = spark.createDataFrame([(min(p), max(p)) for p in required], "a int, b int")
    missing = pairs.join(lines.select("a", "b").distinct(), ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("missing_pairs"))
    report = _fit(cells, made, spots, territory, overseas, others).join(missing)  # one row each
    return Regions(cells, rows, made, spots, lines, report)


def close_border(made: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, length, points): the shortest line between two regions' hulls, for borders that a drawing breaks.
    Both shapes are single rows."""
    import numpy as np

    rings = {r.id: np.array([(p["x"], p["y"]) for p in r["shape"][0][0]]) for r in made.where(F.col("id").isin(first, second)).collect()}  # two rows
    gap, p, q = shapes.shortest_link(rings[first], rings[second])
    return made.sparkSession.createDataFrame([(first, second, gap, [tuple(map(float, x)) for x in (p, q)])], "first string, second string, length double, points array<struct<x:double,y:double>>")


def extend_to_coast(line: DataFrame, territory_shape: DataFrame, most: float = 8.0) -> DataFrame:
    """(length, points): from the end of a border that is nearest to the coast to the coast; fails beyond `most`.

    The coast is that of all parts of the territory, lakes within it too. Both are single pairs' or shapes' rows.
    """
    import numpy as np

    points = [np.array([(p["x"], p["y"]) for p in r["points"]]) for r in line.select("points").collect()]  # one pair's lines
    coasts = [np.array([(p["x"], p["y"]) for p in ring]) for polygon in territory_shape.first()["shape"] for ring in polygon]
    ends = [e for x in points for e in (x[0], x[-1])]
    _, end, coast = min(((shapes.shortest_link(np.vstack([e, e]), c)[0], e, c) for e in ends for c in coasts), key=lambda m: m[0])
    there = shapes.coast_link(end, coast, most)
    return line.sparkSession.createDataFrame([(float(np.hypot(*(end - there))), [tuple(map(float, x)) for x in (end, there)])], "length double, points array<struct<x:double,y:double>>")


def repaired(lines: DataFrame, made: DataFrame, territory: DataFrame, country: str, closures: list[tuple[int, int]], extensions: list[tuple[int, int]], most: float = 8.0) -> DataFrame:
    """Border lines (a, b, part, points) with `repair`: null, or what was added.

    closures: pairs that get the shortest line between their regions (`closure`) if they have no border and don't touch.
    extensions: pairs whose border is then prolonged to the coast (`coast`), by `most` at most; one without a border is
    an error. Both are lists that a person writes, a line or two each.
    """
    spark = lines.sparkSession
    out = lines.withColumn("repair", F.lit(None).cast("string"))
    schema = "a int, b int, part int, points array<struct<x:double,y:double>>, repair string"
    added: dict[tuple[int, int], list[tuple]] = {}
    of = lambda pair: lines.where((F.col("a") == pair[0]) & (F.col("b") == pair[1]))
    for pair in sorted({(min(p), max(p)) for p in closures}):
        if of(pair).isEmpty():
            link = close_border(made, *(f"{country}-region-{n:03d}" for n in pair)).first()
            if link.length > 0:
                added[pair] = [(*pair, 1, link.points, "closure")]
    coast = written(topology.polygons(territory.select(*XY, F.lit(1).alias("label"))), "coast") if extensions else None
    for pair in sorted({(min(p), max(p)) for p in extensions}):
        known = written(of(pair).select("a", "b", "part", "points"), "line").union(spark.createDataFrame([r[:4] for r in added.get(pair, [])], schema.rpartition(",")[0]))
        count = known.count()
        if not count:
            raise ValueError(f"border {pair} isn't there and can't be prolonged")
        link = extend_to_coast(known, coast, most).first()
        if link.length > 1e-9:
            added.setdefault(pair, []).append((*pair, count + 1, link.points, "coast"))
    return out.unionByName(spark.createDataFrame([r for rows in added.values() for r in rows], schema))


def extract_mask(pixels: DataFrame, known: DataFrame, parent: DataFrame, country: str, drawn: DataFrame, tolerance_cells: int, least_iou: float, least_f: float, tolerance: float = 0.55) -> Regions:
    """Regions of a categorical mask; fails unless the drawing's land and the parent's cells agree.

    known: rgb, id (ending in region-<number>); drawn, parent: x, y of either land.
    """
    grid_ = pixels.select(*XY)
    land = lambda cells: grid_.join(cells.select(*XY).distinct().withColumn("value", F.lit(1)), XY, "left").fillna(0, ["value"])
    fit = validate.alignment_gate(written(overlay.boundary_metrics(land(drawn), land(parent), tolerance_cells), "alignment"), least_iou, least_f)
    validate.enforce(fit).count()
    cells = written(mask_regions(pixels, known, parent).select("owner", *XY), "regions")
    rows, made, spots, lines = _regions(cells, country, tolerance)
    none = parent.select(*XY).limit(0)
    return Regions(cells, rows, made, spots, lines, _fit(cells, made, spots, parent, none, none))


def extract_land(mask: DataFrame, countries: DataFrame, unclaimed: DataFrame, tolerance: float = 0.55) -> dict[str, DataFrame]:
    """The land-only run: the mask's report, shapes and coast, and countries clipped to it. mask: x, y, gray, land."""
    from cartolith.sources import images

    land = written(mask.where("land = 1").select(*XY), "land")
    made, coast = land_products(land, tolerance)
    shown, _, free, report = overlay.clip_to_land(countries, countries.select(F.lit("none").alias("id"), *XY).limit(0), land, unclaimed)
    return {"mask_report": images.mask_report(mask), "land": made, "coast": coast, "display": shown, "unassigned": free, "clip_report": report}


def rebuild(pixels: DataFrame, land: DataFrame, known: DataFrame, palette_ids: DataFrame, least: int, opaque: float, most: int = 12, tolerance: float = 0.55, transfer: tuple[DataFrame, colors.Rgb, colors.Rgb] | None = None, names: DataFrame | None = None, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five stages in turn: a reviewed transfer of pixels, the fill, countries and display clip, labels, debug labels.
    Each stage's cells are written.

    transfer: area, donor and receiver of transfer_pixels(); names: id, name, state_group_id; overrides: id, x, y.
    """
    if transfer is not None:
        pixels = written(transfer_pixels(pixels, *transfer), "transferred")
    states = written(with_states(pixels, land), "states")
    named = country_labels(states, known, least, opaque).join(palette_ids.select("id", "label"), "id").select(*XY, "label")
    fill = fill_countries(states, written(named, "labels"), mode="safe", most=most)
    cells = written(fill.cells.where("label > 0").select(*XY, F.col("label").cast("int").alias("label")), "countries")
    made = country_products(cells, palette_ids, tolerance)
    owners = cells.join(palette_ids.select("label", F.col("id").alias("owner")), "label").select("owner", *XY)
    shown, _, free, report = overlay.clip_to_land(owners, cells.select(F.lit("none").alias("id"), *XY).limit(0), land.where("land = 1"), states.where("unclaimed"))
    named_shapes = written(made.shapes.join(palette_ids.select("label", "id"), "label").select("id", "shape"), "named")
    out = {"fill_report": fill.report, "countries": made.rows, "borders": made.borders, "coast": made.coast, "display": shown, "unassigned": free, "clip_report": report, "topology_report": topology_report(made.rings, cells, made.arcs)}
    if names is not None:
        sized = overlay.areas(owners).select(F.col("owner").alias("id"), F.col("area").cast("double").alias("area"))
        spots = overrides if overrides is not None else named_shapes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
        out["labels"] = production_labels(named_shapes, names.join(sized, "id"), spots)
    return out | {"debug_labels": debug_labels(named_shapes)}
