"""Token counts of documents in flat token files that have no index, by a scan for separators.

A file is nothing but ids in a row, little-endian and of one width, in which each document ends with a separator. Byte
ranges of the files are dealt over the cluster, wherever documents begin or end. A range is read and scanned for
separators with one array comparison, which tells the lengths of the documents within it, and is summed up as the
numbers of separators and the place of the last one. A prefix scan over a file's ranges (running sums of separators, and
the running place of the last one), by groups of ranges and then over groups, gives each range's first document the tokens
that it has in earlier ranges. Joins are merges, by hint: a table of packed doc_ids or lengths is a hundredth of its rows' size, from
which Spark would conclude that the driver can broadcast it. Tokens behind a file's last separator are a document that hasn't ended.

Files are read and written through Arrow's file systems, in the shared folder or wherever a URI leads. A writer's attempt
has files of its own, and those that count are named in a table that Spark commits; what a lost executor left is never
read. The table also notes the doc_ids of a file in order, which the scan doesn't read.

Ids are 16 bits wide where the vocabulary and the separator fit in, else 32; a separator that the vocabulary has is an
error. Null texts are empty, and count 0 tokens; rows that repeat are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm.bpe import encode_text, encoding, vocabulary
from cartolith.llm.common import new_folder, written

#: Tokens of a range, and ranges of a group.
RANGE_TOKENS, GROUP = 1 << 20, 1024
#: Tokens from which on a writer begins a new file; documents whose ids are noted together.
FILE_TOKENS, NAMES = 1 << 28, 4096


def width_of(ranks_path: str, eod: int) -> int:
    """Bytes of an id."""
    known = vocabulary(ranks_path)
    if eod in known or eod < 0:
        raise ValueError(f"{eod} is no free id")
    return 2 if max(eod, *known) < 1 << 16 else 4


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, ranks_path: str, pattern: str, eod: int, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> str:
    """Writes docs as flat token files, one or more for each task; returns the folder. eod: an id that no text has."""
    folder, width = new_folder(docs.sparkSession, "tokens"), width_of(ranks_path, eod)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoding(ranks_path, pattern), np.array([eod], f"<u{width}").tobytes()
        system, base = opened(folder)
        out, path, size, seen, names = None, "", 0, 0, []

        def note(closed: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seen - len(names)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([size if closed else None], pa.int64())], ["file", "first", "doc_ids", "bytes"])

        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    path, size, seen = f"{uuid.uuid4().hex}.bin", 0, 0
                    system.create_dir(f"{base}/files", recursive=True)
                    out = system.open_output_stream(f"{base}/files/{path}", compression=None)
                ids = np.frombuffer(encode_text(enc, one.as_py() or ""), "<u4").astype(f"<u{width}").tobytes() + end
                out.write(ids)
                names.append(name)
                size, seen = size + len(ids), seen + 1
                full = size >= file_tokens * width
                if full:
                    out.close()
                    out = None
                if full or len(names) >= NAMES:
                    yield note(full)
                    names = []
        if out is not None:
            out.close()
            yield note(True)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(run, "file string, first bigint, doc_ids array<bigint>, bytes bigint").write.option("compression", "zstd").parquet(f"{folder}/written")
    return folder


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, uri, bytes) of a folder's files."""
    rows = spark.read.schema("file string, bytes bigint").parquet(f"{folder}/written").where("bytes is not null")
    return rows.select("file", F.concat(F.lit(f"{folder}/files/"), "file").alias("uri"), "bytes")


def ranges(rows: DataFrame, width: int, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(file, block, n, ends, last, lengths) of each byte range: its tokens, separators, the place of the last separator
    in the file, and the tokens before the first separator and between them. rows: file, uri, bytes."""
    step = range_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, uri, block, size, eod in zip(*(batch.column(c).to_pylist() for c in ("file", "uri", "block", "bytes", "eod")), strict=True):
                system, path = opened(uri)
                with system.open_input_file(path) as source:
                    data = source.read_at(min(step, size - block * step), block * step)
                ids = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(ids == eod)
                lengths = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([block * range_tokens + int(at[-1]) if len(at) else None], pa.int64()), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "ends", "last", "lengths"],
                )

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step).cast("long"))))
    return cut.repartition(parts, "file", "block").mapInArrow(run, "file string, block bigint, n bigint, ends bigint, last bigint, lengths array<bigint>")


def scan(rows: DataFrame, eod: int, width: int, range_tokens: int = RANGE_TOKENS, group: int = GROUP) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of the documents in flat files. rows: file, uri, bytes (a multiple of width)."""
    found = written(ranges(rows.withColumn("eod", F.lit(eod)), width, range_tokens), "ranges")
    narrow = found.select("file", "block", "n", "ends", "last").withColumn("g", F.floor(F.col("block") / group))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = narrow.groupBy("file", "g").agg(F.sum("ends").alias("ends"), F.max("last").alias("last"))
    across = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    groups = groups.select("file", "g", F.coalesce(F.sum("ends").over(across), F.lit(0)).alias("g_ends"), F.max("last").over(across).alias("g_last"))
    placed = narrow.withColumns({"b_ends": F.coalesce(F.sum("ends").over(inside), F.lit(0)), "b_last": F.max("last").over(inside)}).join(groups.hint("merge"), ["file", "g"])
    carried = F.col("block") * range_tokens - F.coalesce("b_last", "g_last", F.lit(-1)) - 1
    placed = placed.where("ends > 0").select("file", "block", (F.col("g_ends") + F.col("b_ends")).alias("ordinal"), carried.alias("carried"))
    each = found.select("file", "block", F.posexplode("lengths").alias("i", "length")).hint("merge").join(placed, ["file", "block"])
    ended = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = narrow.groupBy("file").agg(F.sum("n").alias("size"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("open"), F.sum("ends").alias("ordinal"))
    rest = whole.where("size > open").select("file", "ordinal", (F.col("size") - F.col("open")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ordinal, doc_id) as the writer noted them."""
    rows = spark.read.schema("file string, first bigint, doc_ids array<bigint>").parquet(f"{folder}/written")
    return rows.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def report(docs: DataFrame, ranks_path: str, pattern: str, eod: int) -> DataFrame:
    """doc_id and n_tokens of each document, by way of flat token files."""
    spark = docs.sparkSession
    folder = write(docs, ranks_path, pattern, eod)
    counted = scan(files(spark, folder), eod, width_of(ranks_path, eod))
    return counted.join(names(spark, folder).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
