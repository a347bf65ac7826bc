"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cartolith-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def measured_broadcasts(spark: SparkSession) -> None:
    """Has the session broadcast without being asked only what a shuffle has measured, not what files make it believe.

    Cells in order pack to less than a hundredth of their rows: files of a few MB would be sent through the driver as tables of
    GBs. What the session would have broadcast by the files' size is its bound for measured sizes then, unless it has one.
    """
    by_files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(by_files) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(by_files))
        spark.conf.set(by_files, "-1")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again; cuts the lineage of loops."""
    measured_broadcasts(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
