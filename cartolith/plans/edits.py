"""Edits of a map whose features are sets of cells. Each edit is a function from tables to tables.

countries, regions: owner, x, y. country_rows, region_rows: one row a feature. "Touches" means that one cell is shared,
and a feature whose last cell goes is removed with its row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import text
from cartolith.operators import features as ft
from cartolith.operators import grid, overlay, shapes, topology
from cartolith.operators.overlay import XY
from cartolith.session import written

#: A region that is covered by more than this share goes over as a whole.
MOSTLY = 0.85
POINTS = "points array<struct<x:double,y:double>>"


@dataclass
class Map:
    countries: DataFrame
    country_rows: DataFrame
    regions: DataFrame
    region_rows: DataFrame


def _owned(cells: DataFrame, owner: str, area: DataFrame) -> DataFrame:
    return area.select(F.lit(owner).alias("owner"), *XY)


def give(cells: DataFrame, target: str, area: DataFrame, from_owners: DataFrame | None = None) -> DataFrame:
    """cells with an area given to the target and taken from all others, or from those that from_owners (owner) names."""
    area = area.select(*XY).distinct()
    if from_owners is None:
        rest = overlay.subtract(cells, area)
    else:
        named = cells.join(from_owners, "owner", "left_semi")
        rest = cells.join(from_owners, "owner", "left_anti").unionByName(overlay.subtract(named, area))
    return overlay.union(rest.where(F.col("owner") != target).select("owner", *XY), cells.where(F.col("owner") == target).select("owner", *XY).union(_owned(cells, target, area)))


def expand_country(countries: DataFrame, target: str, brush: DataFrame, land: DataFrame) -> DataFrame:
    """The brush's land given to a country; nothing changes if the brush holds no land."""
    return give(countries, target, overlay.intersect(brush, land))


def expand_region(regions: DataFrame, region_rows: DataFrame, target: str, brush: DataFrame, country: DataFrame) -> DataFrame:
    """The brush's part of the country given to a region and taken from regions of the same country only; nothing
    changes if there is no such region."""
    parent = region_rows.where(F.col("id") == target).select("country_id")
    if parent.isEmpty():
        return regions
    siblings = region_rows.join(parent, "country_id", "left_semi").select(F.col("id").alias("owner"))
    return give(regions, target, overlay.intersect(brush, country), siblings)


def component_at(cells: DataFrame, x: int, y: int, steps=grid.AROUND_8) -> DataFrame:
    """The connected cells around a cell; none if it isn't one of them."""
    labelled = grid.components(cells.select(*XY).distinct(), steps)
    here = labelled.where((F.col("x") == x) & (F.col("y") == y)).select("component")
    return labelled.join(here, "component", "left_semi").select(*XY)


def claim_island(m: Map, x: int, y: int, land: DataFrame, country: str, region: str | None = None) -> Map:
    """The island under a click given to a country, and to a region: the one named, or the country's nearest.

    Nearest is by the regions' mean cells. Regions of others lose the island's cells.
    """
    island = component_at(land, x, y)
    countries = give(m.countries, country, island)
    if region is None:
        centres = m.regions.groupBy("owner").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).join(m.region_rows.where(F.col("country_id") == country).select(F.col("id").alias("owner")), "owner")
        click = m.regions.sparkSession.createDataFrame([("click", float(x), float(y), "all")], "key string, x double, y double, g string")
        found = overlay.nearest_in_group(click, centres.select(F.col("owner").alias("id"), F.col("owner").alias("ord"), "x", "y", F.lit("all").alias("g")), "g").first()
        region = found.id if found else None
    regions = give(m.regions, region, island) if region else overlay.subtract(m.regions, island)
    return _pruned(Map(countries, m.country_rows, regions, m.region_rows))


def _pruned(m: Map) -> Map:
    """Rows without cells go."""
    alive = lambda rows, cells: rows.join(cells.select(F.col("owner").alias("id")).distinct(), "id", "left_semi")
    return Map(m.countries, alive(m.country_rows, m.countries), m.regions, alive(m.region_rows, m.regions))


def lasso_cells(spark, points: list[tuple[float, float]]) -> DataFrame:
    """Cells inside a stroke that is snapped to the grid and closed; crossings fill by the even-odd rule."""
    ring = shapes.grid_line(np.array([*points, points[0]], float))
    if len(ring) < 4:
        return spark.createDataFrame([], "x int, y int")
    rows = [("lasso", [[[{"x": float(x), "y": float(y)} for x, y in ring]]])]
    shape = spark.createDataFrame(rows, f"id string, shape {topology.SHAPE}")
    return shapes.rasterized(shape).select(*XY)


def territory_at(m: Map, x: int, y: int, land: DataFrame) -> DataFrame:
    """Cells of the country and of the land that are connected to a click."""
    here = m.countries.where((F.col("x") == x) & (F.col("y") == y)).select("owner")
    part = component_at(m.countries.join(here, "owner", "left_semi"), x, y)
    return overlay.intersect(part, component_at(land, x, y))


def region_territory_at(country: DataFrame, x: int, y: int, land: DataFrame) -> DataFrame:
    """The click's land within a country, or the country's own part where it has no land there."""
    on_land = overlay.intersect(country, component_at(land, x, y)).select(*XY)
    return on_land if not on_land.isEmpty() else component_at(country, x, y)


def sources_of(m: Map, territory: DataFrame) -> DataFrame:
    """One row: the only source country (or null), the sources' names in order of id, and the territory's area."""
    found = overlay.touching(m.countries, territory).select(F.col("owner").alias("id")).join(m.country_rows.select("id", "name"), "id", "left")
    names = F.array_sort(F.collect_list(F.struct("id", F.coalesce("name", "id").alias("name"))))
    row = found.agg(F.when(F.count("id") == 1, F.max("id")).alias("source_id"), F.array_join(F.transform(names, lambda s: s["name"]), ", ").alias("source_names"))
    return row.join(territory.agg(F.count(F.lit(1)).alias("area")))  # one row each


def color_neighbours(m: Map, territory: DataFrame, within: float) -> DataFrame:
    """One row: the theme slots of countries that touch a territory or whose mean cell is near its own."""
    touch = overlay.touching(m.countries, territory).select("owner")
    at = territory.agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))
    centre = m.countries.groupBy("owner").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = centre.join(F.broadcast(at)).where((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 < within**2).select("owner")  # `at` is one row
    slots = touch.union(near).distinct().join(m.country_rows.select(F.col("id").alias("owner"), "slot"), "owner")
    return slots.agg(F.array_sort(F.collect_set("slot")).alias("slots"))


def create_country(m: Map, territory: DataFrame, name: str, slot: int | None = None, capital: bool = True, within: float = 50.0, source_region: str | None = None) -> Map:
    """A new country on a territory, numbered after the largest id, coloured unlike its neighbours.

    Regions that it covers for more than MOSTLY (or the named one) go over whole under new ids, others are cut and their
    part goes over; without any, the territory becomes a capital region if `capital` is set.
    """
    spark = territory.sparkSession
    number = ft.next_number(m.country_rows, "country-").first().number
    new = f"country-{number:03d}"
    if slot is None or not 0 <= slot <= 7:
        slot = color_neighbours(m, territory, within).select(ft.free_slot(F.col("slots")).alias("s")).first().s
    share = overlay.touching(m.regions, territory).withColumnRenamed("area", "inside").join(overlay.areas(m.regions), "owner")
    share = share.withColumn("whole", (F.col("inside") / F.col("area") > MOSTLY) | F.col("owner").eqNullSafe(F.lit(source_region)))
    met = share.join(m.region_rows.withColumnRenamed("id", "owner"), "owner").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("owner")))  # a territory's regions
    own = F.startswith(F.col("owner"), F.concat("country_id", F.lit("-")))
    slug = F.when(own, F.expr("substring(owner, length(country_id) + 2)")).when(F.col("name").isNotNull(), text.slug(F.col("name"))).otherwise(F.concat(F.lit("region-"), text.padded(F.col("k"), 2)))
    new_id = F.when(F.col("whole"), F.concat(F.lit(f"{new}-"), slug)).otherwise(F.concat(F.lit(f"{new}-region-"), text.padded(F.col("k"), 2)))
    met = met.withColumn("new_id", new_id)
    whole = met.where("whole").select("owner", "new_id")
    moved = m.regions.join(whole, "owner").select(F.col("new_id").alias("owner"), *XY)
    part = overlay.intersect(m.regions, territory).join(met.where("not whole").select("owner", "new_id"), "owner").select(F.col("new_id").alias("owner"), *XY)
    stay = overlay.subtract(m.regions.join(whole, "owner", "left_anti"), territory).select("owner", *XY)
    old_capital = F.coalesce("is_capital", F.lit(False))
    fresh = met.select(F.col("new_id").alias("id"), F.coalesce("name", F.concat(F.lit("Region "), F.col("k").cast("string"))).alias("name"), F.lit(new).alias("country_id"), F.col("k").cast("int").alias("number"), F.when(F.col("whole"), F.lit(capital) | old_capital).otherwise(old_capital).alias("is_capital"))
    regions, rows = stay.union(moved).union(part), m.region_rows.join(whole.select(F.col("owner").alias("id")), "id", "left_anti").unionByName(fresh)
    if capital and met.isEmpty():
        regions = stay.union(_owned(stay, f"{new}-region-01", territory))
        rows = m.region_rows.unionByName(spark.createDataFrame([(f"{new}-region-01", name, new, 1, True)], "id string, name string, country_id string, number int, is_capital boolean"))
    countries = give(m.countries, new, territory)
    country_rows = m.country_rows.unionByName(spark.createDataFrame([(new, name, slot)], "id string, name string, slot int"))
    return _pruned(Map(countries, country_rows, regions, rows))


def create_region(m: Map, territory: DataFrame, region_id: str, name: str, country: str, capital: bool = False) -> Map:
    """A new region on a territory; regions that it mostly covers go, others are cut."""
    spark = territory.sparkSession
    number = ft.next_number(m.region_rows.where(F.col("country_id") == country), "region-").first().number
    share = overlay.touching(m.regions, territory).withColumnRenamed("area", "inside").join(overlay.areas(m.regions), "owner")
    gone = share.where(F.col("inside") / F.col("area") > MOSTLY).select("owner")
    stay = overlay.subtract(m.regions.join(gone, "owner", "left_anti"), territory).select("owner", *XY)
    rows = m.region_rows.unionByName(spark.createDataFrame([(region_id, name, country, number, capital)], "id string, name string, country_id string, number int, is_capital boolean"))
    return _pruned(Map(m.countries, m.country_rows, stay.union(_owned(stay, region_id, territory)), rows))


def transfer_region(m: Map, region: str, country: str) -> Map:
    """A region with its cells to another country, under an id of that country that no other region has.

    It stays a capital only where the new country has none.
    """
    row = m.region_rows.where(F.col("id") == region).first()
    if row is None or row.country_id is None or row.country_id == country or m.country_rows.where(F.col("id") == country).isEmpty():
        return m
    tail = region[len(row.country_id) + 1 :] if region.startswith(f"{row.country_id}-") else region
    new, k = f"{country}-{tail}", m.region_rows.where(F.col("country_id") == country).count() + 1
    while not m.region_rows.where(F.col("id") == new).isEmpty():
        new, k = f"{country}-region-{k:02d}", k + 1
    has = not m.region_rows.where((F.col("country_id") == country) & F.col("is_capital")).isEmpty()
    area = m.regions.where(F.col("owner") == region).select(*XY)
    here = F.col("id") == region
    rows = ft.edited(m.region_rows, here, {"country_id": F.lit(country), "is_capital": F.lit(bool(row.is_capital) and not has)})
    rows = ft.edited(rows, here, {"id": F.lit(new)})
    regions = ft.edited(m.regions, F.col("owner") == region, {"owner": F.lit(new)})
    return _pruned(Map(give(m.countries, country, area), m.country_rows, regions, rows))


def redraw(m: Map, lasso: DataFrame, land: DataFrame, country: str, region: str | None = None) -> Map:
    """A lasso's land given to a country, or its part of the country to one of its regions."""
    if region is None:
        return _pruned(Map(expand_country(m.countries, country, lasso, land), m.country_rows, m.regions, m.region_rows))
    inside = m.countries.where(F.col("owner") == country)
    return _pruned(Map(m.countries, m.country_rows, expand_region(m.regions, m.region_rows, region, lasso, inside), m.region_rows))


def stroke_samples(line: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Inner points of a stroke that vote for the region that it cuts."""
    if len(line) <= 2:
        return [((line[0][0] + line[1][0]) / 2, (line[0][1] + line[1][1]) / 2)]
    step = max(1, len(line) // 25)
    return [*line[1:-1:step], line[len(line) // 2]]


def slice_region(m: Map, stroke: list[tuple[float, float]], country: str, selected: str | None = None, labels: DataFrame | None = None) -> Map:
    """The region under a stroke cut in two; the part with its label, else the larger one, keeps its identity.

    Regions are tried by their stroke points, most first; nothing changes if the stroke parts none. labels: id, x, y.
    """
    spark = m.regions.sparkSession
    line = [tuple(p) for p in shapes.grid_line(np.array(stroke, float)).tolist()]
    if len(line) < 2:
        return m
    mine = m.regions.join(m.region_rows.where(F.col("country_id") == country).select(F.col("id").alias("owner")), "owner", "left_semi")
    points = spark.createDataFrame([(float(x), float(y)) for x, y in stroke_samples(line)], "x double, y double")
    ranked = ft.stroke_scores(points, mine, selected).orderBy(F.desc("score"), "owner").collect()  # regions under one stroke
    for row in ranked:
        parts = shapes.side_of_line(mine.where(F.col("owner") == row.owner), line)
        sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
        if len(sizes) < 2:
            continue
        keep = max(sizes, key=lambda p: (sizes[p], -p))
        label = labels.where(F.col("id") == row.owner).select(F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")) if labels is not None else None
        held = parts.join(label, XY).select("part").first() if label is not None else None
        keep = held.part if held else keep
        number = ft.next_number(m.region_rows.where(F.col("country_id") == country), "region-").first().number
        new = f"{country}-region-{number:02d}"
        cut = parts.where(F.col("part") != keep).select(F.lit(new).alias("owner"), *XY)
        rows = m.region_rows.unionByName(spark.createDataFrame([(new, f"Region {number}", country, number, False)], "id string, name string, country_id string, number int, is_capital boolean"))
        return Map(m.countries, m.country_rows, overlay.subtract(m.regions, cut).select("owner", *XY).union(cut), rows)
    return m


def snap_regions(m: Map, country: str, whole: bool, reach: int | None = None) -> DataFrame:
    """A country's region cells clipped to it and grown over its gaps; without `whole`, to its parts with regions."""
    territory = m.countries.where(F.col("owner") == country).select(*XY)
    mine = m.regions.join(m.region_rows.where(F.col("country_id") == country).select(F.col("id").alias("owner")), "owner", "left_semi")
    if not whole:
        labelled = grid.components(territory)
        held = overlay.intersect(labelled, mine).select("component").distinct()
        territory = labelled.join(held, "component", "left_semi").select(*XY)
    return overlay.absorb_gaps(mine, territory, reach)


def outlines(cells: DataFrame) -> DataFrame:
    """(id, shape) of each owner. Owners get numbers by name, so the label grid is one table."""
    from cartolith.operators.ranking import numbered

    names = numbered(cells.select(F.col("owner").alias("id")).distinct(), ["id"], "label")
    labels = cells.join(names, F.col("owner") == F.col("id")).select(*XY, F.col("label").cast("int").alias("label"))
    return topology.polygons(labels).join(names, "label").select("id", "shape")


def borders_and_labels(m: Map, old_country_labels: DataFrame, old_region_labels: DataFrame) -> dict[str, DataFrame]:
    """Border lines and label points of countries and regions; labels stay where their feature still holds them."""
    out = {}
    for kind, cells, rows, old in (("country", m.countries, m.country_rows, old_country_labels), ("region", m.regions, m.region_rows, old_region_labels)):
        made = written(outlines(cells), f"{kind}-outlines")
        out[f"{kind}_borders"] = made.select("id", F.posexplode(F.flatten("shape")).alias("part", "line"))
        inner = shapes.inner_points(made).select("id", F.col("x").alias("px"), F.col("y").alias("py"))
        spots = ft.kept_labels(made.join(inner, "id"), old)
        out[f"{kind}_labels"] = spots.join(rows.select("id", "name"), "id").join(overlay.areas(cells).withColumnRenamed("owner", "id"), "id")
    return out


def delete_region(m: Map, region: str) -> Map:
    return Map(m.countries, m.country_rows, m.regions.where(F.col("owner") != region), ft.delete(m.region_rows, region))


class History:
    """Versions of tables, for undo and redo; the oldest of more than `most` are forgotten."""

    def __init__(self, now: Map, most: int = 30):
        self.now, self.most, self.past, self.future = now, most, [], []

    def apply(self, edit) -> Map:
        self.past = [*self.past[-(self.most - 1) :], self.now]
        self.now, self.future = edit(self.now), []
        return self.now

    def undo(self) -> Map:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> Map:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return self.now
