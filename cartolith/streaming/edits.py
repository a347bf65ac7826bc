"""A log of edits as a stream: the latest row of each feature, and counts of edits in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "seq long, at timestamp, id string, action string, name string"


def latest(log: DataFrame) -> DataFrame:
    """(id, name, seq) after all edits of a batch or stream: the last by seq wins, deleted ids go."""
    last = log.groupBy("id").agg(F.max_by(F.struct("action", "name"), "seq").alias("e"), F.max("seq").alias("seq"))
    return last.where(F.col("e.action") != "delete").select("id", F.col("e.name").alias("name"), "seq")


def activity(log: DataFrame, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """(start, action, n) in tumbling windows; edits later than `late` behind the newest are left out."""
    counted = log.withWatermark("at", late).groupBy(F.window("at", width), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "action", "n")


def keep_state(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the latest rows to path after each batch, as a new version beside the old one."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("id").agg(F.max_by(F.struct("action", "name"), "seq").alias("e"), F.max("seq").alias("seq")).select("id", "e.action", "e.name", "seq")
        old = spark.read.schema("id string, action string, name string, seq long").parquet(f"{path}/{batch_id - 1}") if batch_id else fresh.limit(0)
        both = old.unionByName(fresh).groupBy("id").agg(F.max_by(F.struct("action", "name"), "seq").alias("e"), F.max("seq").alias("seq"))
        both.select("id", "e.action", "e.name", "seq").write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
