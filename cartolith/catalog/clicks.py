"""Queries on clicked areas, holes, drawn masks, label checks, placements and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.catalog import fixtures as fx
from cartolith.catalog import plans, query
from cartolith.functions import geometry as g
from cartolith.operators import features as ft
from cartolith.operators import grid, overlay, validate
from cartolith.plans import edits, extraction
from cartolith.session import new_folder, table
from cartolith.sources import geojson, images

_AROUND = "(VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) o(dx, dy)"
_SIDE = "(VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx, dy)"
_PAIR = f"{fx.GRID}, {fx.OWNED}, {fx.MASK}"


def _around_sql(name: str, cells: str, x: int, y: int) -> str:
    """The cells that hang together with one cell, corners included."""
    return f"{name}(x, y) AS (SELECT x, y FROM {cells} WHERE x = {x} AND y = {y} UNION SELECT c.x, c.y FROM {name} n, {_AROUND}, {cells} c WHERE c.x = n.x + o.dx AND c.y = n.y + o.dy)"


@query(f"""WITH RECURSIVE {fx.GRID}, l AS (SELECT x, y FROM grid WHERE noise < 600), b AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM l),
box AS (SELECT tx.x::INT AS x, ty.y::INT AS y FROM range(-1, 152) tx(x), range(-1, (SELECT y1 + 1 FROM b)) ty(y), b WHERE tx.x BETWEEN x0 AND x1 AND ty.y BETWEEN y0 AND y1),
free AS (SELECT x, y FROM box WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.x = box.x AND l.y = box.y)),
outer_(x, y) AS (SELECT x, y FROM free, b WHERE x IN (x0, x1) OR y IN (y0, y1) UNION SELECT f.x, f.y FROM outer_ n, {_SIDE}, free f WHERE f.x = n.x + o.dx AND f.y = n.y + o.dy)
SELECT x, y FROM box WHERE NOT EXISTS (SELECT 1 FROM outer_ n WHERE n.x = box.x AND n.y = box.y)""")
def filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill_holes(fx.grid(spark, sf_dir).where("noise < 600")).select("x", "y")


_ISLAND = "isle AS (SELECT x, y FROM grid WHERE x BETWEEN 40 AND 49 AND y BETWEEN 2 AND 6)"


@query(f"""WITH {_PAIR}, {plans._REGIONS}, {_ISLAND}, near AS (SELECT arg_min(id, ((ax - 44) * (ax - 44) + (ay - 3) * (ay - 3), id)) AS id FROM (SELECT id, avg(x) AS ax, avg(y) AS ay FROM reg WHERE country = 'country-005' GROUP BY id)),
c AS (SELECT owner, x, y FROM owned o WHERE NOT EXISTS (SELECT 1 FROM isle i WHERE i.x = o.x AND i.y = o.y) UNION ALL SELECT 'country-005', x, y FROM isle),
r AS (SELECT id, x, y FROM reg o WHERE NOT EXISTS (SELECT 1 FROM isle i WHERE i.x = o.x AND i.y = o.y) UNION ALL SELECT near.id, x, y FROM isle, near)
SELECT owner, count(*) AS area, sum(x)::BIGINT AS sx FROM c GROUP BY owner UNION ALL SELECT id, count(*), sum(x)::BIGINT FROM r GROUP BY id""")
def claimed_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of land apart from the rest goes to a far country and to that country's nearest region."""
    cells = fx.grid(spark, sf_dir)
    land = cells.where("(x between 40 and 49 and y between 2 and 6) or x >= 60").select("x", "y")
    m = edits.claim_island(plans._map(spark, sf_dir), 44, 3, land, "country-005")
    both = m.countries.select("owner", "x").unionAll(m.regions.select("owner", "x"))
    return both.groupBy("owner").agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"))


_CLICKED = "band AS (SELECT x, y FROM owned WHERE owner = 'country-002'), land AS (SELECT x, y FROM grid WHERE noise < 500)"


@query(f"""WITH RECURSIVE {_PAIR}, {_CLICKED}, {_around_sql("part", "band", 34, 4)}, {_around_sql("dry", "land", 34, 4)}, {_around_sql("off", "band", 35, 1)},
hit AS (SELECT 'territory' AS kind, x, y FROM part JOIN dry USING (x, y) UNION ALL SELECT 'region on land', x, y FROM band JOIN dry USING (x, y) UNION ALL SELECT 'region off land', x, y FROM off)
SELECT kind, count(*) AS area, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM hit GROUP BY kind""")
def clicked_territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clicks choose: a country's part on land, a region's part on land, and the part itself off land."""
    m = plans._map(spark, sf_dir)
    land = fx.grid(spark, sf_dir).where("noise < 500").select("x", "y")
    band = m.countries.where("owner = 'country-002'").select("x", "y")
    kinds = {"territory": edits.territory_at(m, 34, 4, land), "region on land": edits.region_territory_at(band, 34, 4, land), "region off land": edits.region_territory_at(band, 35, 1, land)}
    parts = [cells.select(F.lit(kind).alias("kind"), "x", "y") for kind, cells in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH {fx.GRID}, b AS (SELECT max(y) - 1 AS last FROM grid), room AS (SELECT (x - 7) // 15 AS i, (y - 1) // 9 AS j, x, y FROM grid, b WHERE x > 7 AND x < 142 AND (x - 7) % 15 <> 0 AND y > 1 AND y < last AND (y - 1) % 9 <> 0)
SELECT min(y::BIGINT * 4294967296 + x) AS component, count(*) AS area FROM room GROUP BY i, j HAVING count(*) >= 20""")
def rooms_of_a_drawn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of one colour between teal lines; specks of another colour within a room are filled."""
    cells = fx.grid(spark, sf_dir)
    top = cells.agg(F.max("y")).first()[0] or 0
    x, y = F.col("x"), F.col("y")
    inside = x.between(7, 142) & y.between(1, top - 1)
    line = inside & (((x - 7) % 15 == 0) | ((y - 1) % 9 == 0) | (y == top - 1))
    shade = lambda teal, fill, speck: F.when(line, teal).when(inside & (F.col("noise") < 60), speck).when(inside, fill).otherwise(255)
    pixels = cells.select("x", "y", shade(60, 200, 10).alias("r"), shade(120, 0, 10).alias("g"), shade(120, 40, 10).alias("b"))
    found = extraction.annotated_mask(pixels, (200, 0, 40), 12, 20)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("area"))


@query(f"""WITH {_PAIR} SELECT owner, 4 * count(*) AS area, sum(8 * x + 2)::BIGINT AS sx, sum(8 * y + 2)::BIGINT AS sy FROM owned GROUP BY owner""")
def placed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of half the size, 7 to the right of and 3 below their place, are fitted to their territory, whose cells are twice as wide."""
    cells = fx.owned(spark, sf_dir)
    away = cells.select("owner", (F.col("x") + 7).alias("x"), (F.col("y") + 3).alias("y"))
    part = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("p")
    twice = cells.select("x", "y", part).select((F.col("x") * 2 + F.col("p.i")).alias("x"), (F.col("y") * 2 + F.col("p.j")).alias("y"))
    moved, _ = extraction.place_regions(away, twice, 1.5, 2.5, 0.25, 0)
    return moved.groupBy("owner").agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH {_PAIR}, {plans._REGIONS}, f AS (SELECT owner AS id, 'Land ' || right(owner, 3) AS name, right(owner, 1)::INT * 30 - 15 AS lx, 3 AS ly, x, y FROM owned
 UNION ALL SELECT id, 'Part ' || right(id, 2), country[11:11]::INT * 30 - 20, 4, x, y FROM reg)
SELECT id, any_value(name) AS name, count(*) AS area, bool_or(x = lx AND y = ly) AS kept FROM f GROUP BY id""")
def labels_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and areas of all labels, and whether the old point is still inside its feature."""
    m = plans._map(spark, sf_dir)
    k = lambda rows, c: rows.select("id", (F.substring(c, 11, 1).cast("int") * 30).alias("k"))
    countries = k(m.country_rows, "id").select("id", (F.col("k") - 14.5).cast("double").alias("x"), F.lit(3.5).cast("double").alias("y"))
    regions = k(m.region_rows, "country_id").select("id", (F.col("k") - 19.5).cast("double").alias("x"), F.lit(4.5).cast("double").alias("y"))
    made = edits.borders_and_labels(m, countries, regions)
    return made["country_labels"].select("id", "name", "area", "kept").union(made["region_labels"].select("id", "name", "area", "kept"))


@query(f"""WITH {fx.SPOTS} SELECT key, x // 50 + 100 * (y // 50) AS id FROM spots""")
def only_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one tile around each point; points lie off the tiles' edges."""
    tile = spark.range(9 * 7).select((F.col("id") % 9 + 100 * F.floor(F.col("id") / 9)).alias("id"), (F.col("id") % 9 * 50).cast("double").alias("x0"), (F.floor(F.col("id") / 9) * 50).cast("double").alias("y0"))
    p = lambda dx, dy: g.point(F.col("x0") + dx, F.col("y0") + dy)
    tiles = tile.select("id", F.array(F.array(F.array(p(0, 0), p(50, 0), p(50, 50), p(0, 50), p(0, 0)))).alias("shape"))
    points = fx.spots(spark, sf_dir).select("key", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return overlay.exactly_one(points, tiles, "key")


@query(f"""WITH {fx.BOXES}, {fx.SPOTS} SELECT b.id, coalesce(x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1, false) AS kept, CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN x ELSE (x0 + x1) / 2 END::DOUBLE AS x,
 CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN y ELSE (y0 + y1) / 2 END::DOUBLE AS y, round(least(greatest(coalesce(x, -1), x0), x1), 6)::DOUBLE AS cx, round(least(greatest(coalesce(y, -1), y0), y1), 6)::DOUBLE AS cy
FROM boxes b LEFT JOIN (SELECT key % 997 AS id, max(x) AS x, max(y) AS y FROM spots GROUP BY 1) s ON s.id = b.id""")
def kept_and_clamped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old label points that their box still holds, else its middle; and the place in the box nearest to the old point."""
    made = fx.box_shapes(spark, sf_dir).join(fx.boxes(spark, sf_dir), "id").select("id", "shape", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    old = fx.spots(spark, sf_dir).groupBy((F.col("key") % 997).alias("id")).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    labels = ft.kept_labels(made, old)
    given = made.join(old, "id", "left").fillna(-1.0, ["x", "y"])
    near = given.select("id", g.clamped_inside(F.col("x"), F.col("y"), F.col("shape")).alias("c")).select("id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))
    return labels.join(near, "id").select("id", "kept", "x", "y", "cx", "cy")


@query("""WITH f AS (SELECT s_suppkey AS id FROM supplier), l AS (SELECT c_custkey * 2 % ((SELECT count(*) FROM customer) + 3) AS id FROM customer), n AS (SELECT id, count(*) AS n FROM l GROUP BY id)
SELECT id, coalesce(n, 0) AS n FROM f FULL JOIN n USING (id) WHERE coalesce(n, 0) <> 1 OR id NOT IN (SELECT id FROM f)""")
def miscounted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    labels = customers.select((F.col("c_custkey") * 2 % (customers.count() + 3)).alias("id"))
    return validate.one_label_each(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), labels)


@query(f"""WITH {fx.BOXES}, p AS (SELECT a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, b.* FROM boxes a, boxes b WHERE a.id = 1 AND b.id = 2)
SELECT 'border' AS kind, round(sqrt(power(greatest(0, x0 - ax1, ax0 - x1), 2) + power(greatest(0, y0 - ay1, ay0 - y1), 2)), 6) AS length FROM p UNION ALL SELECT 'coast', 3.0 FROM p""")
def closed_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest line between two boxes, and a border that ends 3 before a box prolonged to its edge."""
    made = fx.box_shapes(spark, sf_dir).withColumn("id", F.col("id").cast("string")).where("id in ('1', '2')")
    gap = extraction.close_border(made, "1", "2").select(F.lit("border").alias("kind"), F.round("length", 6).alias("length"))
    box = fx.boxes(spark, sf_dir).where("id = 1")
    line = box.select(F.array(*(g.point(F.col("x0") - dx, F.col("y0") + 5) for dx in (40, 3))).alias("points"))
    link = extraction.extend_to_coast(line, made.where("id = '1'"))
    return gap.union(link.select(F.lit("coast"), F.round("length", 6)))


@query("""SELECT 'names' AS kind, sha256(string_agg(n_name, ',' ORDER BY n_name) || chr(10)) AS value FROM nation UNION ALL SELECT 'id', c_custkey::VARCHAR FROM customer
UNION ALL SELECT 'countries', n_name FROM nation UNION ALL SELECT 'copies', n_name FROM nation UNION ALL SELECT 'missing', count(*)::VARCHAR FROM nation WHERE false""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text put in its place and hashed, a list of ids, and a state of collections with a twin and one that is missing."""
    folder = new_folder(spark, "stored")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    geojson.replace_text(names.agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value")), f"{folder}/names.txt", spark)
    geojson.write_ids(table(spark, sf_dir, "customer"), f"{folder}/ids", "c_custkey")
    geojson.write_state({"countries": names}, f"{folder}/state", {"countries": "copies"})
    state = geojson.read_state(spark, f"{folder}/state", {n: names.schema for n in ("countries", "copies", "missing")})
    out = images.file_hashes(spark, f"{folder}/names.txt").select(F.lit("names").alias("kind"), F.col("sha256").alias("value"))
    out = out.union(spark.read.text(f"{folder}/ids").select(F.lit("id"), "value"))
    for name in ("countries", "copies"):
        out = out.union(state[name].select(F.lit(name), "value"))
    return out.union(state["missing"].agg(F.lit("missing"), F.count(F.lit(1)).cast("string")))
