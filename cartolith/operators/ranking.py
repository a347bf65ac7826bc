"""Numbers, ranks and percentiles with a total order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import written


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """rows with their place, from 1, in a total order: range partitions, their sizes, and places within them."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    spot = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_n", spot).join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_n")).cast("long")).drop("_part", "_base", "_n")


def tercile(place: Column, count: Column) -> Column:
    """1, 2 or 3 for the place-th (from 1) of count rows; remainders go to the later thirds."""
    return F.least(F.lit(3), F.floor((place - 1) * 3 / count) + 1).cast("int")


def tercile_ranks(rows: DataFrame, group: list[str], area: str, tie: str) -> DataFrame:
    window = Window.partitionBy(*group)
    place = F.row_number().over(window.orderBy(F.desc(area), tie))
    return rows.withColumn("rank", tercile(place, F.count(F.lit(1)).over(window)))


def label_rank(area: Column) -> Column:
    return F.when(area >= 30000, 1).when(area >= 9000, 2).otherwise(3)


def upper_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: the value at index ceil((n - 1) p) of the sorted values for each share, and the maximum; 0 if empty.

    Values are counted first, so that what is sorted are distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(counts, ["v"], "k")
    blocks = placed.withColumn("block", F.floor(F.col("k") / 4096))
    base = blocks.groupBy("block").agg(F.sum("n").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("n").over(Window.partitionBy("block").orderBy("v"))
    upto = blocks.withColumn("run", run).join(base.select("block", "base"), "block").select("v", (F.col("run") + F.col("base")).alias("upto"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    upto = upto.join(F.broadcast(total))  # one row
    marks = [F.coalesce(F.min(F.when(F.col("upto") > F.ceil((F.col("total") - 1) * p), F.col("v"))), F.lit(0)).alias(f"p{round(p * 100)}") for p in shares]
    return upto.agg(*marks, F.coalesce(F.max("v"), F.lit(0)).alias("maximum"))


def kth_largest(rows: DataFrame, k: int, size: str, tie: str) -> DataFrame:
    if k < 1:
        raise ValueError("k counts from 1")
    return rows.orderBy(F.desc(size), tie).limit(k).orderBy(size, F.desc(tie)).limit(1)


def unique_ids(rows: DataFrame, key: str, order: str, most_rounds: int = 100) -> DataFrame:
    """rows whose repeated ids got -2, -3 and so on, past suffixes that are taken; first comers keep theirs.

    Repeats of a plain id are numbered at once. Ids that a suffix collides with are settled in further rounds.
    """
    out = rows.withColumn("_wanted", F.col(key)).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    held = rows.select(F.col(key).alias("_held")).distinct()
    settled = out.where("_k = 1").drop("_wanted", "_k")
    open_ = out.where("_k > 1")
    for _ in range(most_rounds):
        if open_.isEmpty():
            return settled
        tried = open_.withColumn(key, F.concat("_wanted", F.lit("-"), F.col("_k").cast("string")))
        clash = tried.join(held, tried[key] == held["_held"], "left_semi")
        good = tried.join(held, tried[key] == held["_held"], "left_anti")
        settled = settled.unionByName(good.drop("_wanted", "_k"))
        held = written(held.union(good.select(key)), "ids")
        top = written(good.groupBy("_wanted").agg(F.max("_k").alias("_top")).unionByName(clash.groupBy("_wanted").agg(F.max("_k").alias("_top"))).groupBy("_wanted").agg(F.max("_top").alias("_top")), "top")
        again = F.row_number().over(Window.partitionBy("_wanted").orderBy(order))
        open_ = written(clash.join(top, "_wanted").withColumn("_k", F.col("_top") + again).drop("_top"), "open")
    raise RuntimeError("ids didn't settle")


def bounded_history(log: DataFrame, owner: str, order: str, most: int = 30) -> DataFrame:
    """Each owner's latest entries."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(order)))
    return log.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def without_repeats(points: DataFrame, owner: str, order: str) -> DataFrame:
    """Points (x, y) that differ from the one before them."""
    w = Window.partitionBy(owner).orderBy(order)
    same = (F.col("x") == F.lag("x").over(w)) & (F.col("y") == F.lag("y").over(w))
    return points.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


def corners(points: DataFrame, owner: str, order: str) -> DataFrame:
    """The ends and turning points of polylines; points without repeats come in."""
    w = Window.partitionBy(owner).orderBy(order)
    px, py, nx, ny = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    ax, ay, bx, by = F.col("x") - px, F.col("y") - py, nx - F.col("x"), ny - F.col("y")
    on = (ax * by - ay * bx == 0) & (ax * bx + ay * by > 0)
    return points.withColumn("_on", F.coalesce(on, F.lit(False))).where("not _on").drop("_on")
