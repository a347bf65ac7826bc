"""Shared folders, written intermediate tables and small helpers."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session (one process) may do without the setting; it gets a temporary folder.
    """
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
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: it cuts the lineage and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more than one row in SHARE is dealt over several tasks.
SHARE = 1000


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, spot: Column | None = None) -> DataFrame:
    """A left join of rows with right, in which no task gets many more than total / SHARE rows of one key.

    right: one row a key; its column n says how many of the `total` rows have that key. Keys with more than a share, at
    most SHARE of them, are broadcast with their number of salts, and stand on the right once a salt, 2 * SHARE times at
    most in all. Rows of a null key meet nothing and are dealt evenly. rows have no columns of right but the keys.

    spot: a hash of a row by which it gets its salt. Rows that come out of a shuffle need one, as a lost task that runs
    again may see them in another order; rows of a written table go by their places there.
    """
    most = max(1, total // SHARE)
    salts = F.when(F.col(n) > most, F.ceil(F.col(n) / most)).otherwise(1).cast("int")
    hot = right.where(F.col(n) > most).select(*keys, salts.alias("x_salts"))
    copies = right.withColumn("x_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    spot = F.xxhash64(F.monotonically_increasing_id()) if spot is None else spot
    no_key = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    salt = F.when(no_key, -1 - F.pmod(spot, F.lit(1 << 20))).otherwise(F.pmod(spot, F.coalesce("x_salts", F.lit(1)))).cast("int")
    return rows.join(F.broadcast(hot), keys, "left").withColumn("x_salt", salt).drop("x_salts").join(copies, [*keys, "x_salt"], "left").drop("x_salt")


#: Hashes are cut to this range for shares of rows.
RANGE = 1 << 62


def in_share(key: Column, share: float) -> Column:
    """Whether the hash of a key lies in that share of all hashes; shares of one in 10^18 still count."""
    return F.pmod(F.xxhash64(key), F.lit(RANGE)) < F.lit(min(RANGE, int(share * RANGE)))


#: Rows that go to a Python worker together, at most; Spark itself bounds their bytes (maxBytesPerBatch, 64 MB).
BATCH_ROWS = 2048


def small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Has the session hand at most BATCH_ROWS rows to Python at once, and most_bytes if given (a larger row goes alone).

    Smaller settings stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most_bytes is not None and not 0 < _bytes(spark.conf.get(key)) <= most_bytes:
        spark.conf.set(key, f"{most_bytes}b")


def _bytes(setting: str) -> int:
    """The number of bytes of a setting like 64m, 65536k or 67108864."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)(?:i?b)?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % 4


def own_name(columns: list[str], name: str) -> str:
    """name, lengthened until no column is called so (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
