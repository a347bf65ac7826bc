"""Grids, rings, points and feature tables made of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.session import table

GRID = """grid AS (SELECT (o_orderkey % 150)::INT AS x, (o_orderkey // 150)::INT AS y, o_orderkey AS k, o_totalprice AS price,
  (o_orderkey * o_orderkey * 31 + o_orderkey * 17) % 1009 AS noise,
  (o_orderkey * o_orderkey * 31 + o_orderkey * 17) % 1009 < 303 AS land,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 128 ELSE 200 END AS r,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 128 ELSE ascii(o_orderpriority) * 5 % 256 END AS g,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 128 ELSE 40 END AS b,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 200 ELSE 255 END AS a,
  ascii(o_orderpriority) - 48 AS label FROM orders)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.ascii("o_orderpriority")
    noise = (k * k * 31 + k * 17) % 1009
    shade = lambda o, f, e: F.when(s == "O", o).when(s == "F", f).otherwise(e)
    return table(spark, sf_dir, "orders").select(
        (k % 150).cast("int").alias("x"), F.floor(k / 150).cast("int").alias("y"), k.alias("k"), F.col("o_totalprice").alias("price"), noise.alias("noise"), (noise < 303).alias("land"),
        shade(0, 128, 200).alias("r"), shade(0, 128, p * 5 % 256).alias("g"), shade(0, 128, 40).alias("b"), F.when(k % 11 == 0, 0).when(k % 5 == 0, 200).otherwise(255).alias("a"), (p - 48).alias("label"),
    )


#: Two overlapping cell sets with owners: bands of the grid, and a shifted mask.
OWNED = "owned AS (SELECT 'country-' || lpad((1 + x // 30)::VARCHAR, 3, '0') AS owner, x, y FROM grid WHERE noise < 700)"
MASK = "mask AS (SELECT x, y FROM grid WHERE noise % 7 < 4 AND x BETWEEN 20 AND 120)"


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where("noise < 700").select(F.concat(F.lit("country-"), F.lpad((1 + F.floor(F.col("x") / 30)).cast("string"), 3, "0")).alias("owner"), "x", "y")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where("noise % 7 < 4 and x between 20 and 120").select("x", "y")


RINGS = """verts AS (SELECT l_orderkey AS id, l_quantity AS x, l_discount * 100 AS y,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
ring AS (SELECT id, i, x, y FROM verts UNION ALL SELECT id, n + 1, x, y FROM verts WHERE i = 1)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring): closed rings of an order's lines."""
    li = table(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.struct(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y")).alias("p"))
    points = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["p"]).alias("pts"))
    return points.select("id", F.concat("pts", F.slice("pts", 1, 1)).alias("ring"))


#: Axis-parallel boxes around suppliers, and points of customers.
BOXES = "boxes AS (SELECT s_suppkey AS id, s_suppkey * 37 % 400 AS x0, s_suppkey * 91 % 300 AS y0, s_suppkey * 37 % 400 + 20 + s_suppkey % 30 AS x1, s_suppkey * 91 % 300 + 15 + s_suppkey % 20 AS y1 FROM supplier)"
SPOTS = "spots AS (SELECT c_custkey AS key, c_custkey * 53 % 430 AS x, c_custkey * 29 % 330 AS y, c_nationkey AS nation FROM customer)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 37 % 400).cast("double"), (k * 91 % 300).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 20 + k % 30).alias("x1"), (y + 15 + k % 20).alias("y1"))


def box_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x, y: g.point(F.col(x), F.col(y))
    return boxes(spark, sf_dir).select("id", F.array(F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")))).alias("shape"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("key"), (k * 53 % 430).cast("double").alias("x"), (k * 29 % 330).cast("double").alias("y"), F.col("c_nationkey").alias("nation"))
