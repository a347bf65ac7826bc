"""Queries on image files, settings, previews, outlines one by one, faces of a drawing and reports of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.catalog import fixtures as fx
from cartolith.catalog import query
from cartolith.operators import topology
from cartolith.plans import extraction
from cartolith.session import new_folder, table
from cartolith.sources import geojson, images


@query(f"""WITH {fx.GRID}, c AS (SELECT 'band-' || (x // 30) AS owner, x, y, CASE WHEN noise < 300 THEN -1 ELSE 0 END AS v FROM grid)
SELECT c.owner, count(*) AS n FROM c LEFT JOIN c l ON l.owner = c.owner AND l.x = c.x - 1 AND l.y = c.y LEFT JOIN c r ON r.owner = c.owner AND r.x = c.x + 1 AND r.y = c.y LEFT JOIN c b ON b.owner = c.owner AND b.x = c.x AND b.y = c.y + 1
LEFT JOIN c bl ON bl.owner = c.owner AND bl.x = c.x - 1 AND bl.y = c.y + 1 LEFT JOIN c br ON br.owner = c.owner AND br.x = c.x + 1 AND br.y = c.y + 1
WHERE c.v = -1 OR (b.v = -1 AND ((l.v = -1 AND bl.v = 0) OR (r.v = -1 AND br.v = 0))) GROUP BY c.owner""")
def border_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border cells of each band once leaks between cells that touch diagonally are closed."""
    cells = fx.grid(spark, sf_dir).select(F.concat(F.lit("band-"), F.floor(F.col("x") / 30).cast("string")).alias("owner"), "x", "y", F.when(F.col("noise") < 300, -1).otherwise(0).alias("value"))
    return extraction.border_preview(cells)


@query(f"""WITH {fx.GRID} SELECT label, count(*)::DOUBLE AS area FROM grid WHERE land GROUP BY label""")
def contour_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines one by one; without a tolerance they hold the cells' areas."""
    made = topology.contour_rings(fx.grid(spark, sf_dir).where("land").select("x", "y", "label"), 0.0, 0.5)
    return topology.ring_areas(made)


@query(f"""WITH {fx.GRID}, {fx.OWNED}, {fx.MASK}, o AS (SELECT owner, x, y FROM owned UNION SELECT 'neighbour', x, y FROM owned WHERE x % 30 < 4), a AS (SELECT DISTINCT x, y FROM o)
SELECT (SELECT count(*) FROM a) AS first_area, (SELECT count(*) FROM mask) AS second_area, (SELECT count(*) FROM a JOIN mask USING (x, y)) AS intersection, (SELECT count(*) FROM (SELECT x, y FROM a UNION SELECT x, y FROM mask)) AS union_area,
 (SELECT count(*) FROM o p JOIN o q ON p.x = q.x AND p.y = q.y AND p.owner < q.owner) AS overlap_area""")
def region_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.owned(spark, sf_dir)
    cells = cells.union(cells.where("x % 30 < 4").select(F.lit("neighbour"), "x", "y"))
    return extraction.region_report(cells, fx.mask(spark, sf_dir)).select("first_area", "second_area", "intersection", "union_area", "overlap_area")


@query(f"""WITH {fx.GRID}, p AS (SELECT x, y, noise % 256 AS v, k % 2 AS i FROM grid)
SELECT 'colours-' || i || '.png' AS file, sum(v)::BIGINT AS red, sum((x * 7 + y) % 256)::BIGINT AS green, sum(255)::BIGINT AS alpha, NULL::BIGINT AS land FROM p GROUP BY i
UNION ALL SELECT 'mask.png', NULL, NULL, NULL, count(*) FILTER (v >= 100) FROM p""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images in colour and a grey mask, written by tasks and read again."""
    cells = fx.grid(spark, sf_dir).select("x", "y", (F.col("noise") % 256).alias("v"), (F.col("k") % 2).alias("i"))
    height = (cells.agg(F.max("y")).first()[0] or 0) + 1
    folder = new_folder(spark, "images")
    images.write_png(cells, [F.col("v"), (F.col("x") * 7 + F.col("y")) % 256, F.lit(9), F.lit(255)], F.concat(F.lit("colours-"), F.col("i").cast("string")), 150, height, folder)
    images.write_png(cells, [F.col("v")], F.lit("mask"), 150, height, folder)
    size = (150, height)
    read = images.read_pixels(spark, f"{folder}/colours-*.png", size).groupBy(F.substring_index("path", "/", -1).alias("file"))
    sums = read.agg(*(F.sum(c).alias(n) for c, n in (("r", "red"), ("g", "green"), ("a", "alpha")))).withColumn("land", F.lit(None).cast("long"))
    none = [F.lit(None).cast("long").alias(n) for n in ("red", "green", "alpha")]
    mask = images.mask_report(images.read_binary_mask(spark, f"{folder}/mask.png", 100, size))
    return sums.union(mask.select(F.lit("mask.png"), *none, "land_cells"))


@query("""SELECT 'nations' AS name, count(*)::VARCHAR AS value FROM nation UNION ALL SELECT 'limits.first', min(n_name) FROM nation UNION ALL SELECT DISTINCT 'limits.last', 'none' FROM nation UNION ALL SELECT DISTINCT 'mode', 'safe' FROM nation""")
def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of settings made of a table, read with defaults for what it leaves out."""
    path = new_folder(spark, "settings") + "/settings.json"
    found = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("nations"), F.struct(F.min("n_name").alias("first")).alias("limits"))
    geojson.replace_text(found.select(F.to_json(F.struct("nations", "limits")).alias("value")), path, spark)
    read = geojson.read_config(spark, path, {"mode": "safe", "nations": 0, "limits": {"first": "", "last": "none"}})
    rows = [("nations", str(read["nations"])), *((f"limits.{k}", v) for k, v in read["limits"].items()), ("mode", read["mode"])]
    return spark.createDataFrame(rows, "name string, value string")
