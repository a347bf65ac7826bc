"""Queries that run whole edits and extractions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.catalog import fixtures as fx
from cartolith.catalog import query
from cartolith.operators import overlay, shapes, validate
from cartolith.plans import edits, extraction

_PAIR = f"{fx.GRID}, {fx.OWNED}, {fx.MASK}"
_REGIONS = "reg AS (SELECT owner || CASE WHEN y < 50 THEN '-region-01' ELSE '-region-02' END AS id, owner AS country, x, y FROM owned)"
#: Rows of regions as they are before an edit.
_ROWS = "rws AS (SELECT DISTINCT id, 'Part ' || right(id, 2) AS name, country AS country_id, right(id, 1)::INT AS number, right(id, 2) = '01' AS is_capital FROM reg)"


def _map(spark: SparkSession, sf_dir: str) -> edits.Map:
    """The five bands of the grid as countries, each of two regions (upper and lower rows)."""
    cells = fx.owned(spark, sf_dir)
    half = F.when(F.col("y") < 50, "-region-01").otherwise("-region-02")
    regions = cells.select(F.concat("owner", half).alias("owner"), "x", "y")
    rows = cells.select(F.col("owner").alias("id"), F.concat(F.lit("Land "), F.substring("owner", -3, 3)).alias("name"), F.substring("owner", -1, 1).cast("int").alias("slot")).distinct()
    region_rows = regions.select(F.col("owner").alias("id"), F.concat(F.lit("Part "), F.substring("owner", -2, 2)).alias("name"), F.substring("owner", 1, 11).alias("country_id"), F.substring("owner", -1, 1).cast("int").alias("number"), F.endswith("owner", F.lit("01")).alias("is_capital")).distinct()
    return edits.Map(cells, rows, regions, region_rows)


def _whole(m: edits.Map) -> DataFrame:
    """(id, area, name, country_id, number, is_capital) of regions, and of countries with their slot as the number."""
    regions = overlay.areas(m.regions).withColumnRenamed("owner", "id").join(m.region_rows, "id")
    countries = overlay.areas(m.countries).withColumnRenamed("owner", "id").join(m.country_rows, "id")
    return regions.select("id", "area", "name", "country_id", "number", "is_capital").union(countries.select("id", "area", "name", F.lit(None), F.col("slot"), F.lit(None)))


_COUNTRIES = "SELECT owner AS id, count(*) AS area, {name} AS name, NULL AS country_id, {slot} AS number, NULL AS is_capital FROM c GROUP BY owner"
_OLD_COUNTRIES = _COUNTRIES.format(name="'Land ' || right(owner, 3)", slot="right(owner, 1)::INT")
#: An area that covers most of one region's cells and fewer of another's.
_AREA = "area AS (SELECT x, y FROM grid WHERE x BETWEEN 30 AND 64 AND y BETWEEN 0 AND 44)"
_SHARE = "share AS (SELECT id, any_value(country) AS country, count(*) AS n, count(*) FILTER (x BETWEEN 30 AND 64 AND y BETWEEN 0 AND 44) AS inside FROM reg GROUP BY id)"


def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).where("x between 30 and 64 and y between 0 and 44").select("x", "y")


@query(f"""WITH {_PAIR}, {_AREA}, b AS (SELECT x, y FROM area JOIN grid USING (x, y) WHERE noise < 900),
n AS (SELECT owner, x, y FROM owned WHERE owner = 'country-002' UNION SELECT 'country-002', x, y FROM b UNION SELECT owner, x, y FROM owned o WHERE owner <> 'country-002' AND NOT EXISTS (SELECT 1 FROM b WHERE b.x = o.x AND b.y = o.y))
SELECT owner, count(*) AS area FROM n GROUP BY owner""")
def expand_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.areas(edits.expand_country(_map(spark, sf_dir).countries, "country-002", _area(spark, sf_dir), fx.grid(spark, sf_dir).where("noise < 900")))


@query(f"""WITH {_PAIR}, {_AREA}, {_REGIONS}, b AS (SELECT a.x, a.y FROM area a JOIN owned o ON o.x = a.x AND o.y = a.y AND o.owner = 'country-002' WHERE (SELECT max(y) FROM grid) >= 50),
n AS (SELECT id, x, y FROM reg WHERE id = 'country-002-region-02' UNION SELECT 'country-002-region-02', x, y FROM b UNION SELECT id, x, y FROM reg r WHERE id <> 'country-002-region-02' AND (country <> 'country-002' OR NOT EXISTS (SELECT 1 FROM b WHERE b.x = r.x AND b.y = r.y)))
SELECT id AS owner, count(*) AS area FROM n GROUP BY id""")
def expand_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lasso's part of a country given to one of its regions; regions of others keep their cells. Grids of fewer than
    51 rows don't have the region, and stay as they are."""
    m = _map(spark, sf_dir)
    return overlay.areas(edits.redraw(m, _area(spark, sf_dir), fx.grid(spark, sf_dir), "country-002", "country-002-region-02").regions)


@query(f"""WITH {_PAIR}, {_AREA}, {_REGIONS}, {_ROWS}, {_SHARE}, met AS (SELECT *, inside > 0.85 * n AS whole, row_number() OVER (ORDER BY id) AS k FROM share WHERE inside > 0),
named AS (SELECT *, CASE WHEN whole THEN 'country-006-' || id[13:] ELSE 'country-006-region-' || lpad(k::VARCHAR, 2, '0') END AS fresh FROM met),
cut AS (SELECT CASE WHEN m.whole OR (m.inside IS NOT NULL AND r.x BETWEEN 30 AND 64 AND r.y BETWEEN 0 AND 44) THEN m.fresh ELSE r.id END AS id, r.x, r.y FROM reg r LEFT JOIN named m USING (id)),
now AS (SELECT id, name, country_id, number, is_capital FROM rws WHERE id NOT IN (SELECT id FROM named WHERE whole) UNION ALL SELECT fresh, 'Part ' || right(id, 2), 'country-006', k::INT, whole OR right(id, 2) = '01' FROM named),
c AS (SELECT owner, x, y FROM owned o WHERE NOT EXISTS (SELECT 1 FROM area a WHERE a.x = o.x AND a.y = o.y) UNION ALL SELECT 'country-006', x, y FROM area)
SELECT id, area, name, country_id, number, is_capital FROM (SELECT id, count(*) AS area FROM cut GROUP BY id) JOIN now USING (id) UNION ALL
{_COUNTRIES.format(name="CASE WHEN owner = 'country-006' THEN 'New' ELSE 'Land ' || right(owner, 3) END", slot="CASE WHEN owner = 'country-006' THEN 0 ELSE right(owner, 1)::INT END")}""")
def create_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region is covered by more than 85 % and goes over whole, another is cut."""
    return _whole(edits.create_country(_map(spark, sf_dir), _area(spark, sf_dir), "New"))


@query(f"""WITH {_PAIR}, {_REGIONS}, {_ROWS}, k AS (SELECT 'country-003-region-' || lpad((count(*) + 1)::VARCHAR, 2, '0') AS fresh FROM rws WHERE country_id = 'country-003'),
cut AS (SELECT CASE WHEN id = 'country-001-region-01' THEN fresh ELSE id END AS id, x, y FROM reg, k), now AS (SELECT CASE WHEN id = 'country-001-region-01' THEN fresh ELSE id END AS id, name,
 CASE WHEN id = 'country-001-region-01' THEN 'country-003' ELSE country_id END AS country_id, number, is_capital AND id <> 'country-001-region-01' AS is_capital FROM rws, k),
c AS (SELECT CASE WHEN owner = 'country-001' AND y < 50 THEN 'country-003' ELSE owner END AS owner, x, y FROM owned)
SELECT id, area, name, country_id, number, is_capital FROM (SELECT id, count(*) AS area FROM cut GROUP BY id) JOIN now USING (id) UNION ALL {_OLD_COUNTRIES}""")
def transfer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capital region whose id the new country has already; there it is no capital."""
    m = edits.transfer_region(_map(spark, sf_dir), "country-001-region-01", "country-003")
    return _whole(edits.Map(m.countries, m.country_rows, m.regions, m.region_rows))


@query(f"""WITH {_PAIR}, {_AREA}, {_REGIONS}, {_ROWS}, {_SHARE}, cut AS (SELECT id, x, y FROM reg r WHERE id NOT IN (SELECT id FROM share WHERE inside > 0.85 * n) AND NOT EXISTS (SELECT 1 FROM area a WHERE a.x = r.x AND a.y = r.y) UNION ALL SELECT 'new', x, y FROM area),
now AS (SELECT * FROM rws UNION ALL SELECT 'new', 'Fresh', 'country-002', (SELECT max(number) + 1 FROM rws WHERE country_id = 'country-002'), false), c AS (SELECT * FROM owned)
SELECT id, area, name, country_id, number, is_capital FROM (SELECT id, count(*) AS area FROM cut GROUP BY id) JOIN now USING (id) UNION ALL {_OLD_COUNTRIES}""")
def create_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(edits.create_region(_map(spark, sf_dir), _area(spark, sf_dir), "new", "Fresh", "country-002"))


@query(f"""WITH {_PAIR}, {_AREA} SELECT CASE WHEN count(DISTINCT owner) = 1 THEN max(owner) END AS source_id, string_agg(DISTINCT 'Land ' || right(owner, 3), ', ' ORDER BY 'Land ' || right(owner, 3)) AS source_names, (SELECT count(*) FROM area) AS area FROM owned JOIN area USING (x, y)""")
def lasso_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.sources_of(_map(spark, sf_dir), _area(spark, sf_dir))


@query(f"""WITH {fx.GRID} SELECT DISTINCT x, y FROM grid WHERE x BETWEEN 10 AND 39 AND y BETWEEN 5 AND 44""")
def lasso_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = edits.lasso_cells(spark, [(10, 5), (40, 5), (40, 45), (10, 45)])
    return overlay.intersect(fx.grid(spark, sf_dir).select("x", "y"), inside)


@query(f"""WITH {fx.BOXES} SELECT id, count(*) AS area FROM boxes, range(0, 460) tx(x), range(0, 360) ty(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY id""")
def rasterized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.rasterized(fx.box_shapes(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("area"))


@query(f"""WITH {fx.BOXES} SELECT id, least(x1 - x0, y1 - y0) / 2 AS clearance FROM boxes""")
def deepest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearances are exact to the tolerance; those of these boxes are halves, to which they are rounded up."""
    return shapes.inner_points(fx.box_shapes(spark, sf_dir), 0.2).select("id", (F.floor((F.col("clearance") + 0.2) * 2) / 2).alias("clearance"))


_STATES = "st AS (SELECT x, y, noise < 700 AND NOT (a >= 1 AND r = 128 AND g = 128 AND b = 128) AS walk, noise < 700 AND (a < 1 OR (r = 0 AND g = 0 AND b = 0)) AS unknown FROM grid)"


@query(f"""WITH RECURSIVE {fx.GRID}, {_STATES}, w AS (SELECT x, y, unknown FROM st WHERE walk), e AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny FROM w a, (VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) o(dx, dy), w b WHERE b.x = a.x + dx AND b.y = a.y + dy),
d(x, y, d) AS (SELECT x, y, 0 FROM w WHERE NOT unknown UNION SELECT e.nx, e.ny, d.d + 1 FROM d JOIN e USING (x, y) JOIN w t ON t.x = e.nx AND t.y = e.ny AND t.unknown WHERE d.d < 60), f AS (SELECT x, y, min(d)::BIGINT AS d FROM d GROUP BY x, y),
m AS (SELECT coalesce(f.d, -1) AS d FROM w LEFT JOIN f USING (x, y) WHERE unknown), s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM m WHERE d >= 0)
SELECT count(*) AS missing, count(*) FILTER (d >= 0) AS reachable, count(*) FILTER (d BETWEEN 0 AND 3) AS filled, count(*) FILTER (NOT d BETWEEN 0 AND 3) AS unresolved,
 {", ".join(f"count(*) FILTER (d BETWEEN 0 AND {t}) AS within_{t}" for t in (4, 8, 16, 32, 42, 61, 79))}, {", ".join(f"(SELECT coalesce(max(d) FILTER (i = ceil((n - 1) * {p})), 0) FROM s) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))}, (SELECT coalesce(max(d), 0) FROM s) AS maximum FROM m""")
def country_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid(spark, sf_dir)
    states = extraction.with_states(cells.select("x", "y", "r", "g", "b", "a"), cells.select("x", "y", (F.col("noise") < 700).cast("int").alias("land")))
    labels = states.where("country").select("x", "y", F.lit(1).alias("label"))
    return extraction.fill_countries(states, labels, most=3).report



@query(f"""WITH RECURSIVE {_PAIR}, {_REGIONS}, gap AS (SELECT x, y, x // 30 AS band FROM grid WHERE noise >= 700),
e AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny FROM gap a, (VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) o(dx, dy), gap b WHERE b.x = a.x + dx AND b.y = a.y + dy AND a.band = b.band),
c(x, y, c) AS (SELECT x, y, y::BIGINT * 4294967296 + x FROM gap UNION SELECT e.nx, e.ny, c.c FROM c JOIN e USING (x, y)), m AS (SELECT x, y, min(c) AS c FROM c GROUP BY x, y),
near AS (SELECT m.c, arg_min(r.id, ((m.x - r.x) * (m.x - r.x) + (m.y - r.y) * (m.y - r.y), r.id)) AS id FROM m JOIN reg r ON r.x // 30 = m.x // 30 AND r.y BETWEEN m.y - 30 AND m.y + 30 GROUP BY m.c)
SELECT id AS owner, count(*) AS area FROM (SELECT id FROM reg UNION ALL SELECT near.id FROM m JOIN near USING (c)) GROUP BY id""")
def snapped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all countries grown over their country's gaps, each of which goes to its nearest region."""
    m = _map(spark, sf_dir)
    bands = fx.grid(spark, sf_dir).select(F.format_string("country-%03d", 1 + F.floor(F.col("x") / 30)).alias("owner"), "x", "y")
    grown = edits.Map(bands, m.country_rows, m.regions, m.region_rows)
    parts = [edits.snap_regions(grown, f"country-{k:03d}", True) for k in range(1, 6)]  # the five bands of the grid's width
    return overlay.areas(functools.reduce(DataFrame.unionByName, parts))


@query(f"""WITH {_PAIR}, {_REGIONS} SELECT CASE WHEN id = 'country-001-region-01' AND y < 20 AND (SELECT max(y) FROM grid) >= 20 THEN 'country-001-region-03' ELSE id END AS owner, count(*) AS area FROM reg GROUP BY 1""")
def sliced_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region cut by a level stroke, where the grid reaches down to it; the larger part keeps the id."""
    return overlay.areas(edits.slice_region(_map(spark, sf_dir), [(-3.0, 20.0), (35.0, 20.0)], "country-001").regions)


@query(None)
def photo_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions between lines drawn over the whole grid; a test checks them against a plain flood."""
    cells = fx.grid(spark, sf_dir).select(F.lit("photo").alias("owner"), "x", "y", F.when((F.col("x") % 20 == 10) | (F.col("y") % 15 == 7), -1).otherwise(0).alias("value"))
    return extraction.photo_regions(cells, 5).groupBy("owner", "label").agg(F.count(F.lit(1)).alias("area"))


_BANDS = "band AS (SELECT x, y, noise, (1 + x // 30)::INT AS label, noise < 100 AS edge FROM grid)"


def _banded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels in five colours, some of them of colours of their own that are not opaque, and the ids of the five."""
    edge = F.col("noise") < 100
    band = (1 + F.floor(F.col("x") / 30)).cast("int")
    pixels = fx.grid(spark, sf_dir).select("x", "y", F.lit(200).alias("r"), (band * 10).alias("g"), F.when(edge, 41 + F.col("k") % 7).otherwise(40).cast("int").alias("b"), F.when(edge, 200).otherwise(255).alias("a"), "noise")
    known = spark.range(1, 6).select(F.concat_ws(",", F.lit("200"), (F.col("id") * 10).cast("string"), F.lit("40")).alias("rgb"), F.format_string("country-%03d", "id").alias("id"))
    return pixels, known


@query(f"""WITH {fx.GRID}, {_BANDS} SELECT 'country-' || lpad(label::VARCHAR, 3, '0') AS id, count(*) AS cells, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM (
 SELECT x, y, label FROM band WHERE NOT edge UNION ALL SELECT a.x, a.y, arg_min(s.label, ((a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y), s.y, s.x)) FROM band a JOIN band s ON s.x BETWEEN a.x - 6 AND a.x + 6 AND s.y BETWEEN a.y - 6 AND a.y + 6 AND NOT s.edge WHERE a.edge GROUP BY a.x, a.y) GROUP BY 1""")
def labels_of_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette colours keep their country, other pixels join the nearest one that has a palette colour."""
    pixels, known = _banded(spark, sf_dir)
    found = extraction.country_labels(pixels, known, 20, 0.5)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH {fx.GRID}, {_BANDS}, c AS (SELECT label, count(*) AS area FROM band WHERE noise < 900 GROUP BY label), k AS (SELECT label, area, row_number() OVER (ORDER BY area DESC, label) AS i, count(*) OVER () AS n FROM c)
SELECT 'country-009-region-' || lpad(label::VARCHAR, 3, '0') AS id, label AS number, area, least(3, (i - 1) * 3 // n + 1)::INT AS label_rank, (label % 5)::INT AS style_index FROM k""")
def regions_of_a_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on a categorical mask, from its alignment to feature rows."""
    pixels, known = _banded(spark, sf_dir)
    pixels = pixels.withColumn("b", F.lit(40))
    named = known.select("rgb", F.concat(F.lit("country-009-region-"), F.substring("id", -3, 3)).alias("id"))
    parent = pixels.where("noise < 900").select("x", "y")
    made = extraction.extract_mask(pixels, named, parent, "country-009", parent, 3, 0.9, 0.9)
    return made.rows.select("id", "number", "area", "label_rank", "style_index")


@query(f"""WITH {fx.GRID}, b AS (SELECT max(y) - 1 AS last FROM grid), inside AS (SELECT x, y FROM grid, b WHERE x BETWEEN 7 AND 142 AND y BETWEEN 1 AND last), terr AS (SELECT x, y FROM grid WHERE x >= 30),
 room AS (SELECT 1 + (x - 7) // 45 AS region, x, y FROM grid, b WHERE x > 7 AND x < 142 AND (x - 7) % 45 <> 0 AND y > 1 AND y < last),
 near AS (SELECT a.x, a.y, arg_min(r.region, ((a.x - r.x) * (a.x - r.x) + (a.y - r.y) * (a.y - r.y), r.y, r.x)) AS region FROM inside a JOIN room r ON r.x BETWEEN a.x - 3 AND a.x + 3 AND r.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY a.x, a.y),
 kept AS (SELECT n.* FROM near n JOIN terr USING (x, y)) SELECT (SELECT count(*) FROM kept) AS cells, (SELECT count(DISTINCT region) FROM kept) AS regions, round(1.0, 6) AS inside_ratio, round((SELECT count(*) FROM kept) / (SELECT count(*) FROM terr), 6) AS contour_iou,
 (SELECT count(*) FROM kept WHERE x < 40) AS overseas_area, 0 AS labels_outside, 1 AS missing_pairs, ['regions meet an overseas part', 'required borders are missing'] AS failures""")
def regions_of_a_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on linework: three rooms clipped to a territory, judged by the gate."""
    cells = fx.grid(spark, sf_dir)
    top = cells.agg(F.max("y")).first()[0] or 0
    x, y = F.col("x"), F.col("y")
    lines = cells.where(x.between(7, 142) & y.between(1, top - 1) & (((x - 7) % 45 == 0) | y.isin(1, top - 1))).select("x", "y")
    seeds = spark.createDataFrame([(12 + 45 * i, 3, 1 + i) for i in range(3)], "x int, y int, region int")
    made = extraction.extract_linework(lines, seeds, (0, 0, 149, top), 5, 1, "country-007", cells.where("x >= 30").select("x", "y"), cells.where("x < 40").select("x", "y"), cells.where("x < 0").select("x", "y"), [(1, 2), (1, 3)])
    report = validate.linework_gate(made.report, 0.9, 0.1, 0.0, 0.0)
    n = made.cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("owner").alias("regions"))
    return n.join(report).select("cells", "regions", F.round("inside_ratio", 6).alias("inside_ratio"), F.round("contour_iou", 6).alias("contour_iou"), "overseas_area", "labels_outside", "missing_pairs", "failures")  # one row each


@query(f"""WITH {fx.GRID}, {fx.OWNED} SELECT (SELECT count(*) FROM grid WHERE land) AS land_cells, (SELECT count(*) FROM grid WHERE land)::DOUBLE AS vector_area, (SELECT count(*) FROM owned JOIN grid USING (x, y) WHERE land) AS shown,
 (SELECT count(*) FROM grid WHERE land AND NOT noise < 700 AND noise % 5 <> 0) AS unassigned""")
def land_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolith.functions import geometry as g

    cells = fx.grid(spark, sf_dir)
    mask = cells.select("x", "y", F.lit(255).alias("gray"), F.col("land").cast("int").alias("land"))
    out = extraction.extract_land(mask, fx.owned(spark, sf_dir), cells.where("noise % 5 = 0").select("x", "y"), 0.0)
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    area = out["land"].agg(F.sum(g.area(F.col("shape"))).alias("vector_area"))
    return out["mask_report"].select("land_cells").join(area).join(count(out["display"], "shown")).join(count(out["unassigned"], "unassigned"))  # one row each


@query(f"""WITH {fx.GRID}, {_BANDS} SELECT 'country-' || lpad(label::VARCHAR, 3, '0') AS id, 'Land ' || label AS name, count(*)::DOUBLE AS area_world, CASE WHEN count(*) >= 30000 THEN 1 WHEN count(*) >= 9000 THEN 2 ELSE 3 END::INT AS label_rank, 1::BIGINT AS parts FROM band GROUP BY label""")
def rebuilt_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages over the grid; every cell is land, so each band is one country of one part."""
    pixels, known = _banded(spark, sf_dir)
    ids = spark.range(1, 6).select(F.col("id").cast("int").alias("label"), F.format_string("country-%03d", "id").alias("id"), F.lit(200).alias("r"), (F.col("id") * 10).cast("int").alias("g"), F.lit(40).alias("b"))
    fill = pixels.withColumn("b", F.lit(40)).withColumn("a", F.lit(255))
    names = ids.select("id", F.concat(F.lit("Land "), F.col("label").cast("string")).alias("name"), F.lit(None).cast("string").alias("state_group_id"))
    nowhere = pixels.select("x", "y").limit(0)
    out = extraction.rebuild(fill.drop("noise"), pixels.select("x", "y", F.lit(1).alias("land")), known, ids, 20, 0.5, transfer=(nowhere, (1, 1, 1), (2, 2, 2)), names=names)
    return out["labels"].join(out["debug_labels"].select(F.col("id").alias("country_id"), "parts"), "country_id").select(F.col("country_id").alias("id"), "name", "area_world", "label_rank", "parts")
