"""Feature tables: lookups with integrity checks, upserts, edits of single rows, labels and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.session import written
from cartolith.functions import colors, geometry, text

#: Ranks of cities and the zoom from which each shows.
CITY_ZOOM = {"capital": 0.0, "major": 2.25, "city": 4.0, "town": 6.5, "village": 9.0}
#: Theme slots of known countries.
COUNTRY_SLOTS = {
    "country-002": 5, "country-004": 7, "country-005": 4, "country-006": 1, "country-007": 6, "country-008": 3, "country-009": 0, "country-010": 5,
    "country-011": 2, "country-012": 7, "country-013": 5, "country-014": 1, "country-015": 6, "country-016": 4, "country-017": 0, "country-018": 5,
    "country-019": 2, "country-020": 7, "country-021": 4, "country-022": 1, "country-023": 6, "country-024": 2, "country-025": 0,
}


def checked(rows: DataFrame, good: Column, message: Column | str) -> DataFrame:
    """rows; the query fails at a row for which `good` isn't true.

    The check holds a random term that is always true, so that no later filter is moved in front of it.
    """
    message = F.lit(message) if isinstance(message, str) else message
    return rows.where(F.assert_true(F.coalesce(good, F.lit(False)) & (F.rand() >= 0), message).isNull())


def same_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of the tables has."""
    a, b = first.select(key).distinct().withColumn("a", F.lit(1)), second.select(key).distinct().withColumn("b", F.lit(1))
    odd = a.join(b, key, "full").where(F.col("a").isNull() | F.col("b").isNull())
    return odd.select(key, F.when(F.col("a").isNull(), "second").otherwise("first").alias("side"))


def ids_of_colors(palette: DataFrame, known: DataFrame) -> DataFrame:
    """palette (r, g, b, ...) with the id of each colour; fails at unknown colours and at ids of two colours.

    known: rgb ("r,g,b"), id.
    """
    out = palette.withColumn("rgb", colors.rgb_key()).join(known, "rgb", "left")
    out = checked(out, F.col("id").isNotNull(), F.concat(F.lit("no id for colour "), F.col("rgb")))
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return checked(out.join(twice, "id", "left"), F.col("_n") == 1, F.concat(F.lit("several colours for id "), F.col("id"))).drop("_n")


def palette(cells: DataFrame, least: int, opaque: float, largest: DataFrame | None = None) -> DataFrame:
    """(r, g, b, pixels, opaque_ratio) of colours of enough pixels that are opaque enough.

    largest: r, g, b, largest (pixels of the colour's largest component), which then has to reach `least` too.
    """
    found = cells.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("pixels"), F.avg((F.col("a") == 255).cast("double")).alias("opaque_ratio"))
    found = found.where((F.col("pixels") >= least) & (F.col("opaque_ratio") >= opaque))
    return found if largest is None else found.join(largest.where(F.col("largest") >= least), ["r", "g", "b"])


def overridden(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns replaced where overrides has them, and whether that was so."""
    mine = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    out = rows.join(mine, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).withColumn("overridden", F.coalesce("_there", F.lit(False))).drop("_there", *(f"_{c}" for c in columns))


def upsert_dataset(current: DataFrame, fresh: DataFrame, dataset_id: str, legacy: list[str]) -> DataFrame:
    """current without the dataset's rows and those of legacy countries, and fresh; rows without either stay."""
    gone = F.col("dataset_id").eqNullSafe(F.lit(dataset_id))
    if legacy:
        gone = gone | F.coalesce(F.col("country_id").isin(legacy), F.lit(False))
    return current.where(~gone).unionByName(fresh, allowMissingColumns=True)


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables of one schema differ in any row."""
    return not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty())


def edited(rows: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """rows with values put where key holds."""
    return rows.withColumns({c: F.when(key, v).otherwise(F.col(c)) for c, v in values.items()})


def rename(rows: DataFrame, row_id: str, name: str) -> DataFrame:
    return edited(rows, F.col("id") == row_id, {"name": F.lit(name)})


def set_capital(rows: DataFrame, row_id: str, capital: bool) -> DataFrame:
    return edited(rows, F.col("id") == row_id, {"is_capital": F.lit(capital)})


def move_label(labels: DataFrame, label_id: str, x: float, y: float) -> DataFrame:
    return edited(labels, F.col("id") == label_id, {"x": F.lit(x), "y": F.lit(y)})


def delete(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.where(~F.col("id").eqNullSafe(F.lit(row_id)))


def rekey(regions: DataFrame, labels: DataFrame, borders: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A region's id changed in all three tables; they stay as they are where the new id is blank, equal or taken."""
    new = new.strip()
    if not new or new == old or not regions.where(F.col("id") == new).isEmpty():
        return regions, labels, borders
    swap = lambda df, c: edited(df, F.col(c) == old, {c: F.lit(new)})
    return swap(regions, "id"), swap(labels, "id"), swap(borders, "region_id")


def replace_regions(regions: DataFrame, country_id: str, fresh: DataFrame) -> DataFrame:
    return regions.where(~F.col("country_id").eqNullSafe(F.lit(country_id))).unionByName(fresh)


def next_number(rows: DataFrame, prefix: str) -> DataFrame:
    """One row: the largest number in an id behind the prefix, plus one; 1 without any."""
    return rows.agg((F.greatest(F.lit(0), F.coalesce(F.max(text.id_number(F.col("id"), prefix)), F.lit(0))) + 1).alias("number"))


def theme_slot(existing: Column, row_id: Column) -> Column:
    """A row's own slot, else that of a known country, else a hash of its id."""
    known = F.create_map(*[F.lit(x) for pair in COUNTRY_SLOTS.items() for x in pair])
    return F.coalesce(existing, F.try_element_at(known, row_id), text.color_slot(F.coalesce(row_id, F.lit(""))))


def free_slot(taken: Column, slots: int = 8) -> Column:
    """The smallest slot that isn't taken, 0 if all are."""
    return F.coalesce(F.get(F.array_except(F.array(*(F.lit(i) for i in range(slots))), taken), F.lit(0)), F.lit(0))


def valid_city(row: dict[str, Column]) -> Column:
    """Whether a city's columns are all there and sound: id, name, type, rank, population, x, y."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = row["id"].isNotNull() & row["name"].isNotNull() & (row["type"] == "city") & row["rank"].isin(*CITY_ZOOM)
    return F.coalesce(good & finite(row["population"]) & finite(row["x"]) & finite(row["y"]), F.lit(False))


def strict_cities(cities: DataFrame) -> DataFrame:
    """cities; fails if any row is unsound."""
    return checked(cities, valid_city({c: F.col(c) for c in ("id", "name", "type", "rank", "population", "x", "y")}), "unsound city row")


def is_capital(is_capital: Column, capital: Column, rank: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(is_capital == F.lit(True)) | yes(capital == F.lit(True)) | yes(rank == "capital")


def shows_region_label(capital: Column, is_city: Column) -> Column:
    return ~F.coalesce(capital, F.lit(False)) & ~F.coalesce(is_city, F.lit(False))


def visible_at(zoom: Column, rank: Column, capital: Column) -> Column:
    """Capitals always; others from their rank's zoom on."""
    need = F.try_element_at(F.create_map(*[F.lit(x) for pair in CITY_ZOOM.items() for x in pair]), rank)
    return F.coalesce(capital, F.lit(False)) | F.coalesce(zoom >= need, F.lit(False))


def draw_order(capital: Column, label_rank: Column) -> Column:
    return F.when(F.coalesce(capital, F.lit(False)), 0).otherwise(label_rank)


def with_city_semantics(rows: DataFrame, row_id: str) -> DataFrame:
    """One region that is shown as a city and capital."""
    here = F.col("id") == row_id
    return rows.withColumns({"is_city": F.coalesce(here, F.lit(False)), "is_capital": F.when(here, True).otherwise(F.col("is_capital")), "label_rank": F.when(here, 1).otherwise(F.col("label_rank"))})


def placed_names(regions: DataFrame, pasted: str) -> DataFrame:
    """regions (number, name, ...) named by the lines of a pasted list, in order; missing names stay."""
    lines = regions.sparkSession.range(1).select(F.posexplode(text.list_items(F.lit(pasted))).alias("i", "line"))
    named = regions.join(lines.select((F.col("i") + 1).alias("number"), "line"), "number", "left")
    return named.withColumn("name", F.coalesce("line", "name")).drop("line")


def kept_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, x, y, kept): a feature's old label where the feature still holds it, else its own point.

    features: id, shape, px, py; labels: id, x, y.
    """
    old = features.join(labels.select("id", "x", "y"), "id", "left")
    good = F.coalesce(F.col("x").isNotNull() & geometry.in_multipolygon(F.col("x"), F.col("y"), F.col("shape")), F.lit(False))
    old = old.withColumn("kept", good)
    return old.select("id", F.when(F.col("kept"), F.struct("x", "y")).otherwise(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("at"), "kept").select("id", "at.x", "at.y", "kept")


def country_rows(shapes: DataFrame, palette_ids: DataFrame, by_palette: bool = False) -> DataFrame:
    """Country features: ids, colours, counts and style. shapes: label, shape; palette_ids: label, id, r, g, b.

    by_palette: the style follows the palette's order instead of the id's number.
    """
    joined = shapes.join(palette_ids, "label")
    number = F.col("label") if by_palette else text.id_number(F.col("id"))
    return joined.select(
        "id",
        F.lit("Unassigned").alias("name"),
        F.lit("country").alias("type"),
        F.array("r", "g", "b").alias("rgb"),
        colors.hex_color().alias("color"),
        F.size("shape").alias("polygon_count"),
        (F.size(F.flatten("shape")) - F.size("shape")).alias("hole_count"),
        text.style_index(number - 1, 6).alias("style_index"),
        "shape",
    )


def state_areas(countries: DataFrame) -> DataFrame:
    """(state, area, rank) summed over a state's countries; a country without a state is its own."""
    from cartolith.operators.ranking import label_rank

    state = F.coalesce("state_group_id", "id")
    return countries.groupBy(state.alias("state")).agg(F.sum("area").alias("area")).withColumn("rank", label_rank(F.col("area")))


def component_choice(parts: DataFrame) -> DataFrame:
    """(id, parts, largest_part, share, questionable): whether the largest part (ties: the first) stands for the whole.

    parts: id, part, area.
    """
    out = parts.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("area", -F.col("part"))).alias("largest_part"), (F.max("area") / F.sum("area")).alias("share"))
    return out.withColumn("questionable", (F.col("parts") > 10) | (F.col("share") < 0.75))


def shape_hashes(shapes: DataFrame) -> DataFrame:
    """One row: a map of id to hash of shape, and the hash of all in order of id."""
    each = shapes.select("id", F.sha2(F.to_json("shape"), 256).alias("hash"))
    whole = each.agg(F.array_sort(F.collect_list(F.struct("id", "hash"))).alias("all"))
    return whole.select(F.map_from_entries("all").alias("hashes"), F.sha2(F.array_join(F.transform("all", lambda s: s["hash"]), ""), 256).alias("combined"))


def merkle_digest(hashes: DataFrame, order: str = "id", hash_: str = "hash", fan: int = 4096) -> DataFrame:
    """One row (combined): a digest of all hashes in a total order, at any number of them.

    Runs of `fan` hashes in order are joined and hashed, then runs of those, until one is left; so no row holds more than
    `fan` hashes. One hash alone is its own digest, and that of none is the hash of nothing. Null hashes count as empty ones.
    """
    from cartolith.operators.ranking import numbered

    now = numbered(hashes.select(order, F.coalesce(hash_, F.lit("")).alias("hash")), [order], "n").select("n", "hash")
    while True:
        now = written(now, "digests")
        if now.limit(2).count() < 2:
            return now.agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("combined"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda s: s["hash"]), "")
        now = now.groupBy((F.floor((F.col("n") - 1) / fan) + 1).alias("n")).agg(F.sha2(joined, 256).alias("hash"))


def stroke_scores(points: DataFrame, cells: DataFrame, selected: str | None, owner: str = "owner") -> DataFrame:
    """(owner, score): sample points of a stroke on each owner's cells, 2 more for the selected one if it has any."""
    on = points.select(F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).join(cells, ["x", "y"])
    score = F.count(F.lit(1)) + F.when(F.col(owner).eqNullSafe(F.lit(selected)), 2).otherwise(0)
    return on.groupBy(owner).agg(score.alias("score"))


#: What each base-map mode shows.
LAYERS = {
    "land_fill": lambda m: m["vector"] & (m["mode"] != "landOverlay"),
    "unassigned_fill": lambda m: m["vector"] & ~m["land"],
    "unclaimed_fill": lambda m: m["vector"] & ~m["land"],
    "countries_fill": lambda m: m["vector"] & ~m["land"] & m["country_fills"],
    "coastline": lambda m: m["vector"] & (m["mode"] != "landOverlay") & m["coast"],
    "countries_border": lambda m: m["vector"] & ~m["land"] & m["country_borders"],
    "country_labels": lambda m: m["vector"] & ~m["land"],
    "regions_fill": lambda m: m["vector"] & ~m["land"] & m["region_fills"],
    "regions_border": lambda m: m["vector"] & ~m["land"] & m["region_borders"],
    "regions_labels": lambda m: m["vector"] & ~m["land"] & m["region_labels"] & ~m["region_numbers"],
    "region_numbers": lambda m: m["vector"] & ~m["land"] & m["region_numbers"],
    "debug_land": lambda m: m["mode"] == "landOverlay",
}
FLAGS = ("country_fills", "coast", "country_borders", "region_fills", "region_borders", "region_labels", "region_numbers")


def layer_visibility(modes: DataFrame) -> DataFrame:
    """modes (mode, extraction_debug and FLAGS) with a boolean for each layer."""
    m = {"mode": F.col("mode"), "land": F.col("mode").isin("land", "landOverlay"), "vector": (F.col("mode") != "original") | F.col("extraction_debug")}
    m |= {f: F.col(f) for f in FLAGS}
    return modes.withColumns({f"show_{name}": rule(m) for name, rule in LAYERS.items()})
