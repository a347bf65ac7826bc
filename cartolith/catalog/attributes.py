"""Queries on attributes: predicates, ids, ranks, edits of rows, and columns of geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.catalog import query
from cartolith.catalog import fixtures as fx
from cartolith.functions import colors, text
from cartolith.functions import geometry as g
from cartolith.operators import features as ft
from cartolith.operators import ranking, validate
from cartolith.session import table
from cartolith.sources import geojson

_STATE = """CASE WHEN a < 1 OR (r = 0 AND g = 0 AND b = 0) THEN 'o' WHEN r = 128 AND g = 128 AND b = 128 THEN 'u' ELSE 'c' END"""


@query(f"""WITH {fx.GRID}, t AS (SELECT land, {_STATE} AS s FROM grid)
SELECT count(*) FILTER (NOT land) AS ocean, count(*) FILTER (land AND s = 'c') AS country, count(*) FILTER (land AND s = 'u') AS unclaimed,
 count(*) FILTER (land AND s = 'o') AS unknown_land, count(*) FILTER (NOT land AND s = 'c') AS country_outside_land, count(*) FILTER (NOT land AND s = 'u') AS unclaimed_outside_land FROM t""")
def mask_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = colors.mask_states()
    return fx.grid(spark, sf_dir).agg(*(F.count_if(c).alias(n) for n, c in states.items()))


@query(f"""WITH {fx.GRID} SELECT k, (r - b > 60) AS red_land, (noise >= 500)::INT AS bright, greatest(abs(r - 190), abs(g - 120), abs(b - 50)) <= 30 AS near_fill,
 CASE WHEN least((r-200)*(r-200)+(g-0)*(g-0)+(b-40)*(b-40), (r-128)*(r-128)+(g-128)*(g-128)+(b-128)*(b-128)) > 3200 THEN 0 WHEN (r-200)*(r-200)+(g-0)*(g-0)+(b-40)*(b-40) <= (r-128)*(r-128)+(g-128)*(g-128)+(b-128)*(b-128) THEN 1 ELSE 2 END AS nearer,
 (b > r + 16 AND g > r + 10) AS river, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma,
 '#' || lower(printf('%02x%02x%02x', r, g, b)) AS hex, r || ',' || g || ',' || b AS rgb_key FROM grid""")
def color_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).select(
        "k", colors.land_by_red_minus_blue(60).alias("red_land"), colors.land_by_threshold("noise", 500).alias("bright"), (colors.chebyshev((190, 120, 50)) <= 30).alias("near_fill"),
        colors.nearer_of((200, 0, 40), (128, 128, 128)).alias("nearer"), colors.is_river().alias("river"), F.round(colors.luma(), 6).alias("luma"), colors.hex_color().alias("hex"), colors.rgb_key().alias("rgb_key"),
    )


@query(f"""WITH {fx.GRID} SELECT r, g, b, count(*) AS pixels, round(avg((a = 255)::INT), 6) AS opaque_ratio FROM grid GROUP BY r, g, b HAVING count(*) >= 20 AND avg((a = 255)::INT) >= 0.5""")
def palette_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.palette(fx.grid(spark, sf_dir), 20, 0.5).withColumn("opaque_ratio", F.round("opaque_ratio", 6))


@query("""SELECT r, g, b, c.id FROM (SELECT DISTINCT 200 AS r, ascii(o_orderpriority) * 5 % 256 AS g, 40 AS b FROM orders) p
JOIN (SELECT '200,' || (i * 5 % 256) || ',40' AS rgb, 'country-' || lpad((i - 48)::VARCHAR, 3, '0') AS id FROM range(49, 54) t(i)) c ON c.rgb = r || ',' || g || ',' || b""")
def ids_by_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.lit(200).alias("r"), (F.ascii("o_orderpriority") * 5 % 256).alias("g"), F.lit(40).alias("b")).distinct()
    known = spark.range(49, 54).select(F.concat(F.lit("200,"), (F.col("id") * 5 % 256).cast("string"), F.lit(",40")).alias("rgb"), F.concat(F.lit("country-"), text.padded(F.col("id") - 48, 3)).alias("id"))
    return ft.ids_of_colors(seen, known).select("r", "g", "b", "id")


@query("""WITH t AS (SELECT c_custkey, c_name, c_nationkey FROM customer)
SELECT c_custkey, lower(regexp_replace(c_name, '#', '-')) AS dashed, 'country-' || lpad(c_nationkey::VARCHAR, 3, '0') || '-' || trim(regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9\\s\\-_.,/]', '', 'g'), '[\\s\\-_.,/]+', '-', 'g'), '-') AS slug_id,
 c_nationkey AS number, lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS padded, c_custkey % 5 AS style FROM t""")
def slugs_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.concat(F.lit("country-"), text.padded(F.col("c_nationkey"), 3))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("dashed"), text.prefixed_slug(owner, F.col("c_name")).alias("slug_id"), text.id_number(owner).alias("number"),
        text.padded(F.col("c_custkey"), 6).alias("padded"), text.style_index(F.col("c_custkey"), 5).alias("style"),
    )


@query("""SELECT p_partkey, v AS hash, (v % 8)::INT AS slot FROM (SELECT p_partkey,
 list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS v FROM part)""")
def id_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.id_hash(F.col("p_type")).alias("hash"), text.color_slot(F.col("p_type")).alias("slot"))


_LATIN, _CYRILLIC = "ABDEFGIKLMNOPRSTUVZ", "АБДЕФГИКЛМНОПРСТУВЗ"


@query("""SELECT n_nationkey, trim(regexp_replace('shchuka-yozh-5-' || lower(n_name) || '-' || n_nationkey, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation""")
def cyrillic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names in Cyrillic letters, between signs that slugs don't have."""
    name = F.concat(F.lit("  Щука/Ёж №5 "), F.translate("n_name", _LATIN, _CYRILLIC), F.lit("__"), F.col("n_nationkey").cast("string"), F.lit("--"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.slug(name).alias("slug"))


@query("""SELECT p_partkey, round(least(greatest(p_retailprice, 0), 1925) / 1925 * 359.998 - 179.999, 6) AS lon,
 round(degrees(atan((exp(-z) - exp(z)) / 2)), 6) AS lat, round(least(greatest(p_retailprice, 0), 1925), 6) AS back_x, round(y, 4) AS back_y
FROM (SELECT *, radians((y / 1080 - 0.5) * (359.998 * (1080.0 / 1925.0))) AS z FROM (SELECT *, least(greatest(p_size * 21.0, 0), 1080) AS y FROM part))""")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").select("p_partkey", g.world_to_map(F.col("p_retailprice"), F.col("p_size") * 21.0).alias("m"))
    back = g.map_to_world(F.col("m.x"), F.col("m.y"))
    return out.select("p_partkey", F.round("m.x", 6).alias("lon"), F.round("m.y", 6).alias("lat"), F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 4).alias("back_y"))


@query(f"""WITH {fx.RINGS}, e AS (SELECT id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ring WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT id, count(*) AS vertices, round(abs(sum(coalesce(x * y1 - x1 * y, 0))) / 2, 4) AS area, count(*) FILTER (x = x1 AND y = y1) AS repeated,
 min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM e GROUP BY id""")
def ring_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.rings(spark, sf_dir).withColumn("shape", F.array(F.array("ring")))
    r = r.select("id", g.ring_counts(F.col("shape")).alias("c"), g.area(F.col("shape")).alias("area"), g.bbox(F.col("shape")).alias("box"))
    return r.select("id", F.col("c.vertices").cast("long").alias("vertices"), F.round("area", 4).alias("area"), F.col("c.repeated").cast("long").alias("repeated"), "box.x0", "box.y0", "box.x1", "box.y1")


@query(f"""WITH {fx.BOXES} SELECT id, round((x0 - 10.0) / 2.5, 6) AS lx, round((y0 - 20.0) / 3.0, 6) AS ly, round(x0, 6) AS wx, round(y0, 6) AS wy FROM boxes""")
def affine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.alignment(F.array(*map(F.lit, (0.0, 0.0, 40.0, 40.0))), F.array(*map(F.lit, (10.0, 20.0, 110.0, 140.0))))
    out = fx.boxes(spark, sf_dir).select("id", c.alias("c"), g.to_local(F.col("x0"), F.col("y0"), c).alias("l"))
    w = g.to_world(F.col("l.x"), F.col("l.y"), F.col("c"))
    return out.select("id", F.round("l.x", 6).alias("lx"), F.round("l.y", 6).alias("ly"), F.round(w["x"], 6).alias("wx"), F.round(w["y"], 6).alias("wy"))


@query("""SELECT s_suppkey, round(log2(least(w / 512.0, h / (512.0 * (1080.0 / 1925.0)))) - 0.45, 6) AS zoom,
 round(CASE WHEN z <= 0 THEN 1.2 WHEN z < 2.25 THEN 1.2 + z / 2.25 * (1.05 - 1.2) WHEN z < 6.5 THEN 1.05 + (z - 2.25) / 4.25 * (0.9 - 1.05) ELSE 0.9 END, 6) AS width,
 CASE s_suppkey % 3 WHEN 0 THEN '#d8c8ad' WHEN 1 THEN '#c4d5bc' ELSE '#d8c8ad' END AS color, round(s_suppkey * 137.508 - floor(s_suppkey * 137.508 / 180) * 180, 5) AS hue
FROM (SELECT *, 300 + s_suppkey % 1700 AS w, 200 + s_suppkey * 7 % 900 AS h, s_suppkey % 80 / 10.0 AS z FROM supplier)""")
def zoom_and_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(g.minimum_zoom(300 + k % 1700, 200 + k * 7 % 900), 6).alias("zoom"), F.round(g.interpolated(k % 80 / 10.0, [(0, 1.2), (2.25, 1.05), (6.5, 0.9)]), 6).alias("width"),
        g.palette_color(F.when(k % 3 == 2, 9).otherwise(k % 3).cast("int"), ["#d8c8ad", "#c4d5bc"]).alias("color"), F.round(colors.categorical_hue(k), 5).alias("hue"),
    )


@query(f"""WITH {fx.BOXES} SELECT id, round(CASE id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 1.25 WHEN 2 THEN 2.25 ELSE 3.25 END, 6) AS t,
 round(x0 + (x1 - x0) * CASE id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 1 WHEN 2 THEN 0.75 ELSE 0 END, 6) AS px, round(x1, 6) AS hit_x, round((y0 + y1) / 2, 6) AS hit_y FROM boxes""")
def box_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir).withColumn("t0", F.col("id") % 4 + 0.25)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    b = b.withColumn("p", g.box_point(F.col("t0"), *box))
    t = g.box_parameter(F.col("p.x"), F.col("p.y"), *box)
    hit = g.ray_to_box((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.lit(1.0), F.lit(0.0), *box)
    return b.select("id", F.round(t, 6).alias("t"), F.round("p.x", 6).alias("px"), F.round(hit["x"], 6).alias("hit_x"), F.round(hit["y"], 6).alias("hit_y"))


@query("""WITH v AS (SELECT l_quantity::BIGINT AS q FROM lineitem), s AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT max(q) FILTER (i = ceil((n - 1) * 0.5)) AS p50, max(q) FILTER (i = ceil((n - 1) * 0.9)) AS p90, max(q) FILTER (i = ceil((n - 1) * 0.95)) AS p95, max(q) FILTER (i = ceil((n - 1) * 0.99)) AS p99, max(q) AS maximum FROM s""")
def percentile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.upper_percentiles(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q")


@query("""SELECT p_brand, p_partkey, least(3, (row_number() OVER w - 1) * 3 // count(*) OVER (PARTITION BY p_brand) + 1)::INT AS rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def tercile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tercile_ranks(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "rank")


@query("""SELECT state, round(area, 2) AS area, (CASE WHEN area >= 30000 THEN 1 WHEN area >= 9000 THEN 2 ELSE 3 END)::INT AS rank
FROM (SELECT coalesce(g, c) AS state, sum(a) AS area FROM (SELECT c_nationkey::VARCHAR AS c, CASE WHEN c_nationkey % 3 = 0 THEN 'g' || (c_nationkey % 2) END AS g, c_acctbal AS a FROM customer) GROUP BY 1)""")
def state_label_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(n.cast("string").alias("id"), F.when(n % 3 == 0, F.concat(F.lit("g"), (n % 2).cast("string"))).alias("state_group_id"), F.col("c_acctbal").alias("area"))
    out = rows.groupBy("id", "state_group_id").agg(F.sum("area").alias("area"))
    return ft.state_areas(out).withColumn("area", F.round("area", 2))


@query("""SELECT c_nationkey::VARCHAR AS id, count(*) AS parts, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS largest_part, round(max(c_acctbal) / sum(c_acctbal), 6) AS share,
 count(*) > 10 OR max(c_acctbal) / sum(c_acctbal) < 0.75 AS questionable FROM (SELECT c_nationkey, c_custkey, abs(c_acctbal) + 1 AS c_acctbal FROM customer) GROUP BY 1""")
def component_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_custkey").alias("part"), (F.abs("c_acctbal") + 1).alias("area"))
    return ft.component_choice(parts).withColumn("share", F.round("share", 6))


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN p_brand ELSE p_brand || '-' || k END AS id FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)""")
def dedup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.unique_ids(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("id")), "id", "p_partkey").select("p_partkey", "id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30")
def history_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bounded_history(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 30)


@query("""WITH p AS (SELECT user_id, event_id, floor(value / 40)::INT AS x, floor(value / 70)::INT AS y FROM events),
d AS (SELECT * FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY NOT coalesce(x = lag(x) OVER w AND y = lag(y) OVER w, false)),
c AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, x, y FROM c WHERE NOT coalesce(ax * by_ - ay * bx = 0 AND ax * bx + ay * by_ > 0, false)""")
def stroke_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 40).cast("int").alias("x"), F.floor(F.col("value") / 70).cast("int").alias("y"))
    return ranking.corners(ranking.without_repeats(points, "user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "x", "y")


@query("""SELECT id, country_id, dataset_id FROM (SELECT c_custkey AS id, 'country-' || c_nationkey AS country_id, CASE WHEN c_custkey % 4 = 0 THEN 'set-a' WHEN c_custkey % 4 = 1 THEN 'set-b' END AS dataset_id FROM customer)
 WHERE dataset_id IS DISTINCT FROM 'set-a' AND country_id NOT IN ('country-3', 'country-7') UNION ALL SELECT s_suppkey, 'country-' || s_nationkey, 'set-a' FROM supplier""")
def dataset_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, owner = F.col("c_custkey"), lambda c: F.concat(F.lit("country-"), F.col(c).cast("string"))
    now = table(spark, sf_dir, "customer").select(k.alias("id"), owner("c_nationkey").alias("country_id"), F.when(k % 4 == 0, "set-a").when(k % 4 == 1, "set-b").alias("dataset_id"))
    fresh = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), owner("s_nationkey").alias("country_id"), F.lit("set-a").alias("dataset_id"))
    return ft.upsert_dataset(now, fresh, "set-a", ["country-3", "country-7"])


_CITY = """city AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 13 = 0 THEN 'town' ELSE 'city' END AS type, CASE c_custkey % 6 WHEN 0 THEN 'capital' WHEN 1 THEN 'major' WHEN 2 THEN 'city' WHEN 3 THEN 'town' WHEN 4 THEN 'village' ELSE 'hamlet' END AS rank,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS population, c_custkey % 19 = 0 AS is_capital FROM customer)"""


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rank = F.get(F.array(*map(F.lit, ("capital", "major", "city", "town", "village", "hamlet"))), (k % 6).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 13 == 0, "town").otherwise("city").alias("type"), rank.alias("rank"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("population"), (k % 19 == 0).alias("is_capital"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))


@query(f"""WITH {_CITY} SELECT id, type = 'city' AND rank <> 'hamlet' AND population IS NOT NULL AS valid, is_capital OR rank = 'capital' AS capital,
 is_capital OR rank = 'capital' OR coalesce(4.5 >= CASE rank WHEN 'major' THEN 2.25 WHEN 'city' THEN 4 WHEN 'town' THEN 6.5 WHEN 'village' THEN 9 END, false) AS visible,
 NOT is_capital AND type <> 'town' AS region_label, contains(lower(name), '00012') AS found, CASE WHEN is_capital THEN '● ' || name ELSE name END AS label FROM city""")
def city_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir)
    capital = ft.is_capital(F.col("is_capital"), F.lit(None).cast("boolean"), F.col("rank"))
    return c.select(
        "id", ft.valid_city({n: F.col(n) for n in ("id", "name", "type", "rank", "population", "x", "y")}).alias("valid"), capital.alias("capital"), ft.visible_at(F.lit(4.5), F.col("rank"), capital).alias("visible"),
        ft.shows_region_label(F.col("is_capital"), F.col("type") == "town").alias("region_label"), text.matches_search(F.col("name"), "00012").alias("found"), text.capital_label(F.col("name"), F.col("is_capital")).alias("label"),
    )


@query(f"""WITH {_CITY} SELECT id, CASE WHEN id = 12 THEN 'Renamed' ELSE name END AS name, CASE WHEN id = 20 THEN true ELSE is_capital END AS is_capital, id = 30 AS is_city FROM city WHERE id <> 14""")
def row_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("label_rank", F.lit(2))
    out = ft.with_city_semantics(ft.delete(ft.set_capital(ft.rename(c, "12", "Renamed"), "20", True), "14"), "30")
    return out.select(F.col("id").cast("long").alias("id"), "name", F.when(F.col("id") == "30", F.col("id").cast("long") % 19 == 0).otherwise(F.col("is_capital")).alias("is_capital"), "is_city")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'second' ELSE 'first' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a
FULL JOIN (SELECT DISTINCT o_custkey * 3 AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.same_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("k")), "k")


@query("""SELECT n_nationkey AS id, CASE WHEN s.s_acctbal IS NULL THEN n_regionkey * 1.0 ELSE s.s_acctbal END AS x, s.s_acctbal IS NOT NULL AS overridden FROM nation LEFT JOIN (SELECT s_suppkey * 3 AS s_suppkey, s_acctbal FROM supplier) s ON s.s_suppkey = n_nationkey""")
def optional_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("double").alias("x"))
    return ft.overridden(rows, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_acctbal").alias("x")), "id", ["x"])


@query("""SELECT n_nationkey AS number, CASE n_nationkey WHEN 1 THEN 'Alpha' WHEN 2 THEN 'Beta' WHEN 3 THEN 'Gamma' ELSE n_name END AS name FROM nation""")
def pasted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.placed_names(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name")), " Alpha\n\n Beta \nGamma").select("number", "name")


_MODES = ("vector", "terrain", "original", "combined", "land", "landOverlay")


@query(f"""SELECT id, mode, debug AS extraction_debug, (mode <> 'original' OR debug) AND mode <> 'landOverlay' AS show_land_fill, (mode <> 'original' OR debug) AND mode NOT IN ('land', 'landOverlay') AS show_country_labels, mode = 'landOverlay' AS show_debug_land
FROM (SELECT p_partkey AS id, {list(_MODES)}[1 + p_partkey % 6] AS mode, p_partkey % 5 < 2 AS debug FROM part)""")
def layer_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    modes = table(spark, sf_dir, "part").select(k.alias("id"), F.get(F.array(*map(F.lit, _MODES)), (k % 6).cast("int")).alias("mode"), (k % 5 < 2).alias("extraction_debug"), *(F.lit(True).alias(f) for f in ft.FLAGS))
    return ft.layer_visibility(modes).select("id", "mode", "extraction_debug", "show_land_fill", "show_country_labels", "show_debug_land")


@query("""SELECT k AS id, list_filter(['contour IoU is below the minimum', 'boundary F score is below the minimum'], lambda s: (s[1:1] = 'c' AND iou < 0.5) OR (s[1:1] = 'b' AND f < 0.3)) AS failures
FROM (SELECT s_suppkey AS k, s_suppkey % 10 / 10.0 AS iou, s_suppkey % 7 / 7.0 AS f FROM supplier)""")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    report = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 10 / 10.0).alias("iou"), (k % 7 / 7.0).alias("boundary_f"))
    return validate.alignment_gate(report, 0.5, 0.3).select("id", "failures")


@query("""SELECT n_nationkey, ranking, rank, value FROM nation JOIN (VALUES ('area', 1, 'A', '38,6'), ('area', 2, 'B', NULL), ('people', 1, 'C', '9'), ('people', 2, 'A', '7')) t(ranking, rank, country, value) ON country = chr(65 + (n_nationkey % 4)::INT)""")
def ranking_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of nations in rankings that are given with the settings."""
    known = geojson.rankings(spark, {"area": [("A", "38,6"), ("B", None)], "people": [("C", "9"), ("A", "7")]})
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.char(65 + F.col("n_nationkey") % 4).alias("country"))
    return nations.join(F.broadcast(known), "country").select("n_nationkey", "ranking", "rank", "value")


@query("""SELECT s_suppkey AS id, 'Supplier' AS kind, s_acctbal AS x, s_nationkey * 1.0 AS y, s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN 'dark' ELSE 'light' END AS scheme FROM supplier""")
def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolith.session import new_folder

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("Supplier").alias("kind"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 3 == 0, "dark").otherwise("sepia").alias("stored"), g.point(F.col("s_acctbal"), F.col("s_nationkey")).alias("p"))
    path = new_folder(spark, "points") + "/points.geojson"
    geojson.write_collection(geojson.feature_lines(rows, geojson.geometry_json("Point", F.col("p")), ["kind", "name", "stored"]), path)
    read = geojson.points(geojson.properties(geojson.read_features(spark, path).drop("id", "type"), "id string, kind string, name string, stored string"))
    return read.select(F.col("id").cast("long").alias("id"), "kind", "x", "y", "name", geojson.preference(F.col("stored"), ["light", "dark"], "light").alias("scheme"))


@query(f"""WITH {_CITY} SELECT id, rank FROM city WHERE type = 'city' AND rank <> 'hamlet' AND population IS NOT NULL""")
def strict_city_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cities(spark, sf_dir)
    sound = c.where(ft.valid_city({n: F.col(n) for n in ("id", "name", "type", "rank", "population", "x", "y")}))
    return ft.strict_cities(sound).select("id", "rank")


def _two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box as a polygon, and a small one beside it."""
    k = F.col("id")
    ring = lambda x0, y0, x1, y1: F.array(g.point(x0, y0), g.point(x1, y0), g.point(x1, y1), g.point(x0, y1), g.point(x0, y0))
    small = ring(F.lit(900), F.lit(900), 901 + k % 3, F.lit(901))
    return fx.boxes(spark, sf_dir).select(k, F.array(F.array(ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))), F.array(small)).alias("shape"))


@query(f"""WITH {fx.BOXES} SELECT id, (1 + (1 + id % 3 >= 2)::INT)::INT AS parts, CASE WHEN 1 + id % 3 >= 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, (1 + (1 + id % 3 >= 2)::INT)::INT AS lines,
 ((x1 - x0) * (y1 - y0) + CASE WHEN 1 + id % 3 >= 2 THEN 1 + id % 3 ELSE 0 END)::DOUBLE AS area FROM boxes""")
def parts_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _two_parts(spark, sf_dir).withColumn("shape", g.without_small_parts(F.col("shape"), 2.0))
    shape = F.col("shape")
    return kept.select("id", F.size(shape).alias("parts"), g.shape_type(shape).alias("kind"), F.size(g.outline(shape)).alias("lines"), g.area(shape).alias("area"))


@query(f"""WITH {fx.BOXES} SELECT id, (id % 5) * 0.01 <= 0.02 AS same FROM boxes""")
def matching_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    off = (F.col("id") % 5) * 0.01
    return fx.boxes(spark, sf_dir).select("id", g.bounds_match(F.array(*(c * 0 for c in box)), F.array(*(c * 0 + off for c in box)), 0.02).alias("same"))


@query(f"""WITH {fx.BOXES} SELECT id, round(least(greatest(x0, 0), 1925) / 1925 * 359.998 - 179.999, 6) AS x0, round(least(greatest(x1, 0), 1925) / 1925 * 359.998 - 179.999, 6) AS x1,
 round(degrees(atan((exp(-z1) - exp(z1)) / 2)), 6) AS y0, round(degrees(atan((exp(-z0) - exp(z0)) / 2)), 6) AS y1
FROM (SELECT *, radians((y0 / 1080.0 - 0.5) * (359.998 * (1080.0 / 1925.0))) AS z0, radians((y1 / 1080.0 - 0.5) * (359.998 * (1080.0 / 1925.0))) AS z1 FROM boxes)""")
def shapes_on_the_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fx.box_shapes(spark, sf_dir).select("id", g.bbox(g.map_multipolygon(F.col("shape"), lambda x, y: g.world_to_map(x, y))).alias("b"))
    return moved.select("id", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""WITH h AS (SELECT s_suppkey AS id, s_suppkey % 9 / 4.0 AS f, s_suppkey * 13 % 200 AS l, s_suppkey * 7 % 90 AS t, 5 + s_suppkey % 60 AS w, 4 + s_suppkey % 45 AS h FROM supplier),
 s AS (SELECT *, greatest(10, floor(w * f + 0.5)) AS sw, greatest(10, floor(h * f + 0.5)) AS sh FROM h)
SELECT id, floor(l + (w - sw) / 2 + 0.5)::BIGINT AS "left", floor(t + (h - sh) / 2 + 0.5)::BIGINT AS top, sw::BIGINT AS width, sh::BIGINT AS height FROM s""")
def scaled_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    box = g.scaled_overlay(k * 13 % 200, k * 7 % 90, 5 + k % 60, 4 + k % 45, k % 9 / 4.0)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), box.alias("b")).select("id", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("left", "top", "width", "height")))


@query(f"""WITH {fx.BOXES}, h AS (SELECT id, sha256('[[[' || '{{"x":' || x0::DOUBLE || ',"y":' || y0::DOUBLE || '}},{{"x":' || x1::DOUBLE || ',"y":' || y0::DOUBLE || '}},{{"x":' || x1::DOUBLE || ',"y":' || y1::DOUBLE || '}},{{"x":' || x0::DOUBLE || ',"y":' || y1::DOUBLE || '}},{{"x":' || x0::DOUBLE || ',"y":' || y0::DOUBLE || '}}' || ']]]') AS hash FROM boxes)
SELECT count(*) AS shapes, min(hash) AS first, sha256(string_agg(hash, '' ORDER BY id)) AS combined FROM h""")
def hashes_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ft.shape_hashes(fx.box_shapes(spark, sf_dir))
    return row.select(F.size("hashes").cast("long").alias("shapes"), F.array_min(F.map_values("hashes")).alias("first"), "combined")


_LEVEL = "{0} AS (SELECT (i - 1) // 16 + 1 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, ceil(any_value(n) / 16)::BIGINT AS n FROM {1} GROUP BY (i - 1) // 16 + 1)"


@query(f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, sha256(o_orderkey || ':' || o_orderpriority) AS h, count(*) OVER () AS n FROM orders),
{", ".join(_LEVEL.format(f"l{k + 1}", f"l{k}") for k in range(8))} SELECT h AS combined FROM l8""")
def digest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of all orders, in levels of 16."""
    each = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("hash"))
    return ft.merkle_digest(each, fan=16)


@query(f"""WITH {fx.BOXES} SELECT id::VARCHAR AS id, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS parts, (CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END * (x1 - x0) * (y1 - y0))::DOUBLE AS area FROM boxes""")
def nested_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in a file of geometries of all kinds: a polygon, two in collections within one, three with points beside them, a line."""
    from cartolith.session import new_folder

    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.to_json(F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))))
    made = lambda kind, inner: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), inner, F.lit("}"))
    held = lambda *of: F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.concat_ws(",", *of), F.lit("]}"))
    polygon, point, line = made("Polygon", ring), F.lit('{"type":"Point","coordinates":[1,2]}'), F.lit('{"type":"LineString","coordinates":[[1,2],[3,4]]}')
    multi = made("MultiPolygon", F.concat(F.lit("["), ring, F.lit(","), ring, F.lit("]")))
    kind = F.col("id") % 4
    geometry = F.when(kind == 0, held(point, held(multi, held(line, polygon)), held())).when(kind == 1, polygon).when(kind == 2, held(held(polygon), polygon)).otherwise(line)
    rows = fx.boxes(spark, sf_dir).withColumn("geometry", geometry).withColumn("id", F.col("id").cast("string"))
    path = new_folder(spark, "nested") + "/nested.geojson"
    geojson.write_collection(geojson.feature_lines(rows, F.col("geometry"), []), path)
    return geojson.polygonal(geojson.read_geometries(spark, path), ["id"]).select("id", F.size("shape").cast("long").alias("parts"), g.area(F.col("shape")).alias("area"))


@query("""WITH r AS (SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey AS country_id FROM supplier), n AS (SELECT CASE WHEN id = '3' THEN 'x-3' ELSE id END AS id, name, country_id FROM r)
SELECT 'region' AS kind, id, name FROM n WHERE country_id <> 4 UNION ALL SELECT 'region', 'new-' || c_custkey, c_name FROM customer WHERE c_nationkey = 4
UNION ALL SELECT 'label', CASE WHEN id = '3' THEN 'x-3' ELSE id END, CASE WHEN id = '5' THEN '7.0' ELSE '1.0' END FROM r UNION ALL SELECT 'border', CASE WHEN id = '3' THEN 'x-3' ELSE id END, '' FROM r""")
def region_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key changed in three tables (and not changed to one that is taken), a label moved, a country's regions replaced."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("country_id"))
    labels, borders = rows.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), rows.select(F.col("id").alias("region_id"))
    regions, labels, borders = ft.rekey(*ft.rekey(rows, labels, borders, "3", " x-3 "), "2", "4")
    fresh = table(spark, sf_dir, "customer").where("c_nationkey = 4").select(F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("4").alias("country_id"))
    regions = ft.replace_regions(regions, "4", fresh)
    moved = ft.move_label(labels, "5", 7.0, 8.0).select(F.lit("label").alias("kind"), "id", F.col("x").cast("string").alias("name"))
    return regions.select(F.lit("region").alias("kind"), "id", "name").union(moved).union(borders.select(F.lit("border").alias("kind"), F.col("region_id").alias("id"), F.lit("").alias("name")))


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS size FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1 OFFSET 6""")
def seventh_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.kth_largest(table(spark, sf_dir, "customer"), 7, "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("size"))


@query("""WITH t AS (SELECT c_custkey AS id, 'country-' || lpad((c_custkey % 30)::VARCHAR, 3, '0') AS cid, c_custkey % 3 = 0 AS cap, c_nationkey AS rk FROM customer),
 known AS (SELECT * FROM (VALUES ('country-002', 5), ('country-004', 7), ('country-005', 4), ('country-006', 1), ('country-007', 6), ('country-008', 3), ('country-009', 0), ('country-010', 5),
 ('country-011', 2), ('country-012', 7), ('country-013', 5), ('country-014', 1), ('country-015', 6), ('country-016', 4), ('country-017', 0), ('country-018', 5), ('country-019', 2), ('country-020', 7),
 ('country-021', 4), ('country-022', 1), ('country-023', 6), ('country-024', 2), ('country-025', 0)) k(kid, slot))
SELECT id, CASE WHEN cap THEN 0 ELSE rk END::INT AS draw, coalesce(CASE WHEN id % 7 = 0 THEN 3 END, slot, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(cid, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 8)::INT AS slot,
 id::VARCHAR || chr(10) || cid AS label, replace('a/' || id, '/', '-') AS path, replace(format('{:,}', id * 12345), ',', chr(160)) AS big FROM t LEFT JOIN known ON kid = cid""")
def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cid = F.concat(F.lit("country-"), text.padded(k % 30, 3))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), ft.draw_order(k % 3 == 0, F.col("c_nationkey")).cast("int").alias("draw"), ft.theme_slot(F.when(k % 7 == 0, 3), cid).alias("slot"),
        text.numbered_label(k, cid).alias("label"), text.path_safe(F.concat(F.lit("a/"), k.cast("string"))).alias("path"), text.grouped_number(k * 12345).alias("big"),
    )


@query(f"""WITH {fx.GRID}, t AS (SELECT k, r, g + k % 90 AS g, b + k % 70 AS b FROM grid)
SELECT k, r < 120 AND g > r + 18 AND b > r + 18 AND abs(g - b) < 45 AND g < 190 AND b < 190 AND r + g + b > 60 AS teal, 0.299 * r + 0.587 * g + 0.114 * b < 100.05 AND NOT (b > r + 16 AND g > r + 10) AS border,
 CASE WHEN k % 5 = 0 THEN 255 WHEN k % 2 = 0 THEN floor(floor(r * 0.72) * 0.78 + 205 * 0.22) ELSE floor(r * 0.72) END::INT AS preview, r FROM t""")
def drawn_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    px = fx.grid(spark, sf_dir).select("k", "r", (F.col("g") + k % 90).alias("g"), (F.col("b") + k % 70).alias("b"))
    back = F.get(colors.parse_rgb_key(colors.rgb_key()), F.lit(0))
    return px.select("k", colors.is_teal_boundary().alias("teal"), colors.is_border_pixel(100.05).alias("border"), colors.preview_color(k % 2 == 0, k % 5 == 0, F.col("r")).alias("preview"), back.alias("r"))


@query("""SELECT k AS id, list_filter(['regions are not mostly inside the territory', 'contour IoU is below the minimum', 'regions meet an overseas part', 'regions meet another country', 'regions overlap', 'labels are outside their regions', 'shapes are invalid'],
 lambda s: (s[-9:] = 'territory' AND k % 10 / 10.0 < 0.3) OR (s[1:1] = 'c' AND k % 7 / 7.0 < 0.5) OR (s[-4:] = 'part' AND k % 5 > 2) OR (s[-7:] = 'country' AND k % 4 > 1) OR (s = 'regions overlap' AND k % 3 > 0) OR (s[1:1] = 'l' AND k % 2 <> 0) OR (s[1:1] = 's' AND k % 6 <> 0)) AS failures
FROM (SELECT s_suppkey AS k FROM supplier)""")
def placement_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    values = (k % 10 / 10.0, k % 7 / 7.0, (k % 5).cast("double"), (k % 4).cast("double"), (k % 3).cast("double"), k % 2, k % 6)
    report = table(spark, sf_dir, "supplier").select(k.alias("id"), *(v.alias(n) for v, n in zip(values, validate.PLACEMENT, strict=True)))
    return validate.placement_gate(report, 0.3, 0.5, 2.0, 1.0).select("id", "failures")


@query("""SELECT count(*) AS n FROM supplier""")
def guarded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many labels as expected, none of them on a boundary, one for each feature."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit(0.5).alias("clearance"))
    sound = validate.clearance_guard(rows)
    odd = validate.one_label_each(rows, sound.select("id"))
    return validate.expected_count(sound.join(odd.select("id"), "id", "left_anti"), rows.count())


@query("""SELECT user_id, i::INT AS i, x, y FROM (SELECT user_id, generate_subscripts(p, 1) - 1 AS i, unnest(p).x AS x, unnest(p).y AS y FROM (SELECT user_id, [{'x': 0.0, 'y': 0.0}, {'x': (user_id % 9 + 1)::DOUBLE, 'y': (user_id % 9 + 1)::DOUBLE}, {'x': (user_id % 9 + 6)::DOUBLE, 'y': (user_id % 9 + 1)::DOUBLE}] AS p FROM (SELECT DISTINCT user_id FROM events)))""")
def snapped_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolith.operators import shapes

    k = F.col("user_id") % 9 + 1
    points = F.array(g.point(F.lit(0.2), F.lit(-0.4)), g.point(k + 0.3, k - 0.5), g.point(k + 2.0, k + 0.1), g.point(k + 5.4, k + 0.49))
    lines = shapes.grid_lines(table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", points.alias("points")), "user_id")
    return lines.select("user_id", F.posexplode("line").alias("i", "p")).select("user_id", "i", "p.x", "p.y")
