"""Byte-level BPE by overlapping chunks: split, stitch where boundaries resynchronise, encode the pieces.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised alone, so its first boundaries may be wrong
(it can begin within a match) and its last ones too (the match can go on behind its end). A match depends only on
where it begins and on what follows, so once a chunk has one true boundary, all later ones are true up to its end's
margin. Chunk k is stitched to chunk k+1 at the first place in their overlap that is a boundary of both; a place
behind white space is no stitch, for a white-space match looks at what follows it. Pairs of chunks are stitched apart
from each other. Where an overlap has no common boundary, chunks are joined until they are half as long again, and split
once more, so that the work stays in proportion to the text even where it has no boundary at all. The ranges between
stitches are encoded on their own, all over the cluster; decoding concatenates bytes.

Null texts are empty texts; an empty text has no ids. Repeated rows stay as they are, an empty table gives an empty
one. Other columns are kept, whatever their names; decode() gives its column a leading underscore where docs has one
of that name.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import own_name, written

#: Characters of a match's look-ahead, and so of a chunk's end where boundaries aren't trusted.
MARGIN = 4
MADE = ("x_ids", "x_raw")


@functools.lru_cache(maxsize=4)
def vocabulary(ranks_path: str) -> dict[int, bytes]:
    """The bytes of each id."""
    with open(ranks_path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoder of a file of ranks, once per worker."""
    import tiktoken

    ranks = {b: i for i, b in vocabulary(ranks_path).items()}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(chunk: str, pattern: str) -> np.ndarray:
    """Where matches of the pattern begin in the chunk, and its end."""
    at = [m.start() for m in _compiled(pattern).finditer(chunk)]
    return np.array([*at, len(chunk)], dtype=np.int64)


def stitch(chunks: list[str], starts: list[int], marks: list[np.ndarray], pattern: str) -> list[str]:
    """The ranges of the text between stitches.

    chunks: overlapping pieces of one text, in order; starts: where each begins in it; marks: boundaries() of each.
    """
    out: list[str] = []
    text, begin, own, mark = chunks[0], starts[0], 0, marks[0]
    more: list[str] = []  # what follows the text and isn't split yet
    size = len(text)
    for nxt, at, theirs in zip(chunks[1:], starts[1:], marks[1:], strict=True):
        place = None
        if not more:
            trusted = mark[:-1][(mark[:-1] <= len(text) - MARGIN) & (mark[:-1] > own)] + begin
            both = np.intersect1d(trusted[trusted > at], theirs[:-1] + at, assume_unique=True)
            place = next((p for p in both.tolist() if not text[p - begin - 1].isspace()), None)
        if place is not None:
            out.append(text[own : place - begin])
            text, begin, own, mark, size = nxt, at, place - at, theirs, len(nxt)
            continue
        more.append(nxt[begin + size - at :])
        size += len(more[-1])
        if 2 * size >= 3 * len(text):
            text, begin, own, more = "".join([text, *more])[own:], begin + own, 0, []
            mark, size = boundaries(text, pattern), len(text)
    out.append("".join([text, *more])[own:])
    return out


def encode_text(enc, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def decode_ids(words: dict[int, bytes], ids: bytes) -> bytes:
    """The concatenated bytes of ids."""
    return b"".join(map(words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(ranks_path: str, pattern: str, text_at: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words = encoding(ranks_path, pattern), vocabulary(ranks_path)
        for batch in batches:
            ids = [encode_text(enc, t.as_py() or "") for t in batch.column(text_at)]
            more = [pa.array(ids, pa.binary())]
            if decoded:
                more.append(pa.array([decode_ids(words, i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *MADE[: len(more)]])

    return run


def _cut(chunk_chars: int, overlap_chars: int):
    """Long texts to overlapping chunks; the row's other columns stay with the first."""
    step = chunk_chars - overlap_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                text, rest = batch.column("x_text")[r].as_py(), batch.column("x_rest").slice(r, 1)
                starts = list(range(0, max(1, len(text) - overlap_chars), step))
                none = pa.nulls(1, rest.type)
                for k, at in enumerate(starts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("x_row").slice(r, 1), pa.array([k], pa.int32()), rest if k == 0 else none, pa.array([text[at : at + chunk_chars]], pa.string()), pa.array([k == len(starts) - 1])],
                        ["x_row", "x_k", "x_rest", "x_part", "x_last"],
                    )

    return run


def _split(pattern: str, step: int, overlap_chars: int):
    """Adds the places in a text where a chunk has a boundary in its first overlap, and a trusted one in its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text, k in zip(batch.column("x_part").to_pylist(), batch.column("x_k").to_pylist(), strict=True):
                mark = boundaries(text, pattern)[:-1]
                tail = mark[(mark > step) & (mark <= len(text) - MARGIN)]
                tails.append([k * step + p for p in tail.tolist() if not text[p - 1].isspace()])
                heads.append((mark[(mark > 0) & (mark < overlap_chars)] + k * step).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "x_head", "x_tail"])

    return run


def _pieces(group: pa.Table, pattern: str, step: int) -> tuple[list[str], str]:
    """The ranges of a run of chunks up to its end, and the run's text up to the last chunk's end."""
    group = group.sort_by("x_k")
    chunks, at = group.column("x_part").to_pylist(), [k * step for k in group.column("x_k").to_pylist()]
    begin, end = group.column("x_own")[0].as_py(), group.column("x_end")[len(group) - 1].as_py()
    whole = chunks[-1]
    if len(chunks) > 1:
        chunks[0], at[0] = chunks[0][begin - at[0] :], begin
        marks = [boundaries(c, pattern) for c in chunks]
        ranges = stitch(chunks, at, marks, pattern)
        whole = "".join(ranges)
        ranges[-1] = ranges[-1][: len(ranges[-1]) - (len(whole) - (end - begin))] if end is not None else ranges[-1]
        return ranges, whole
    return [whole[begin - at[0] : None if end is None else end - at[0]]], whole


def runs_of(chunks: DataFrame) -> DataFrame:
    """(x_row, x_k, x_run, x_own, x_end): the run that each chunk is in, and where the run begins and ends in its text.

    Neighbouring chunks are told apart at their first common boundary, each pair by itself. Chunks without one are a run
    together. x_end is null at a text's end.
    """
    pairs = chunks.where("not x_last").select("x_row", "x_k", F.col("x_tail").alias("tail"), F.lit(None).cast("array<bigint>").alias("head"))
    pairs = pairs.unionByName(chunks.where("x_k > 0").select("x_row", (F.col("x_k") - 1).alias("x_k"), F.lit(None).cast("array<bigint>").alias("tail"), F.col("x_head").alias("head")))
    met = pairs.groupBy("x_row", "x_k").agg(F.array_min(F.array_intersect(F.max("tail"), F.max("head"))).alias("place"))
    places = chunks.select("x_row", "x_k", "x_last").join(met, ["x_row", "x_k"], "left")
    order = Window.partitionBy("x_row").orderBy("x_k")  # a row a chunk, without its text
    before = F.lag("place").over(order)
    out = places.withColumn("x_own", F.when(F.col("x_k") == 0, 0).otherwise(before)).withColumn("x_run", F.sum(F.col("x_own").isNotNull().cast("int")).over(order))
    run = Window.partitionBy("x_row", "x_run")
    return out.select("x_row", "x_k", "x_run", F.max("x_own").over(run).alias("x_own"), F.max("place").over(run).alias("x_end"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", chunk_chars: int = 32768, overlap_chars: int = 1024, decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs and a binary column of each text's ids, as little-endian unsigned 32-bit integers.

    decoded: a name for one more column, of the bytes that the ids decode to, made where a text's ids are whole. Without
    keep_text the texts are left out. chunk_chars is twice overlap_chars at least.

    A text of at most chunk_chars characters is one chunk, and encoded where it is read. The chunks of longer ones are
    dealt over the cluster, pre-tokenised, stitched pair by pair and encoded there; a text's ids meet at the end only,
    to be one value. Where chunks without a common boundary lie side by side, their run is split again as a whole, and
    a text whose split then doesn't have the run's end as a boundary is one run.
    """
    names = docs.columns
    made = [T.StructField(n, T.BinaryType()) for n in (MADE if decoded else MADE[:1])]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    docs = docs.toDF(*inner.fieldNames())
    at, step = names.index(text), chunk_chars - overlap_chars
    col = F.col(f"c{at}")
    last = [n for n in names if keep_text or n != text] + [ids, *([decoded] if decoded else [])]
    short = docs.where(F.coalesce(F.length(col), F.lit(0)) <= chunk_chars).mapInArrow(
        _encoder(ranks_path, pattern, at, decoded is not None), T.StructType([*inner.fields, *made])
    )
    short = short if keep_text else short.drop(f"c{at}")

    rest = [c for c in inner.fieldNames() if c != f"c{at}"]
    long = docs.where(F.length(col) > chunk_chars).select(F.monotonically_increasing_id().alias("x_row"), F.struct(*rest).alias("x_rest") if rest else F.lit(0).alias("x_rest"), col.alias("x_text"))
    schema = T.StructType([long.schema["x_row"], T.StructField("x_k", T.IntegerType()), T.StructField("x_rest", long.schema["x_rest"].dataType), T.StructField("x_part", T.StringType()), T.StructField("x_last", T.BooleanType())])
    parts = long.mapInArrow(_cut(chunk_chars, overlap_chars), schema)
    parts = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x_row", "x_k")
    places = T.ArrayType(T.LongType())
    chunks = written(parts.mapInArrow(_split(pattern, step, overlap_chars), T.StructType([*schema.fields, T.StructField("x_head", places), T.StructField("x_tail", places)])), "chunks")
    runs = written(runs_of(chunks), "runs")

    joined = written(runs.groupBy("x_row", "x_run").count().where("count > 1").select("x_row", "x_run"), "joined")
    if not joined.isEmpty():

        def check(group: pa.Table) -> pa.Table:
            end = group.sort_by("x_k").column("x_end")[len(group) - 1].as_py()
            begin = group.column("x_own")[0].as_py()
            good = end is None or end - begin in boundaries(_pieces(group, pattern, step)[1], pattern)
            return pa.table([group.column("x_row").slice(0, 0 if good else 1)], ["x_row"])

        suspects = chunks.select("x_row", "x_k", "x_part").join(runs.join(joined, ["x_row", "x_run"], "left_semi"), ["x_row", "x_k"])
        bad = written(suspects.groupBy("x_row", "x_run").applyInArrow(check, "x_row bigint").distinct(), "bad").withColumn("bad", F.lit(True))
        runs = runs.join(bad, "x_row", "left")
        whole = F.coalesce("bad", F.lit(False))
        runs = runs.select("x_row", "x_k", F.when(whole, 0).otherwise(F.col("x_run")).alias("x_run"), F.when(whole, 0).otherwise(F.col("x_own")).alias("x_own"), F.when(~whole, F.col("x_end")).alias("x_end"))

    fields = [T.StructField("x_row", T.LongType()), T.StructField("x_run", runs.schema["x_run"].dataType), *([T.StructField("x_text", T.StringType())] if keep_text else []), made[0]]
    placed = chunks.select("x_row", "x_k", "x_part").join(runs, ["x_row", "x_k"])

    def code(group: pa.Table) -> pa.Table:
        enc = encoding(ranks_path, pattern)
        ranges, _ = _pieces(group, pattern, step)
        texts = [pa.array(["".join(ranges)], pa.string())] if keep_text else []
        return pa.table([*(group.column(c).slice(0, 1) for c in ("x_row", "x_run")), *texts, pa.array([b"".join(encode_text(enc, r) for r in ranges)], pa.binary())], [f.name for f in fields])

    def code_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for i in range(len(batch)):
                yield from code(whole.slice(i, 1)).combine_chunks().to_batches()

    if joined.isEmpty():  # each chunk is a run
        coded = placed.mapInArrow(code_each, T.StructType(fields))
    else:
        several = written(runs.groupBy("x_row", "x_run").count().where("count > 1").select("x_row", "x_run"), "several")
        coded = placed.join(several, ["x_row", "x_run"], "left_anti").mapInArrow(code_each, T.StructType(fields))
        coded = coded.union(placed.join(several, ["x_row", "x_run"], "left_semi").groupBy("x_row", "x_run").applyInArrow(code, T.StructType(fields)))

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("x_run")
        got = b"".join(group.column(MADE[0]).to_pylist())
        texts = [pa.array(["".join(group.column("x_text").to_pylist())], pa.string())] if keep_text else []
        coded = [got, decode_ids(vocabulary(ranks_path), got)] if decoded else [got]
        return pa.table([group.column("x_row").slice(0, 1), *texts, *(pa.array([c], pa.binary()) for c in coded)], [fields[0].name, *(f.name for f in fields[2:-1]), *(f.name for f in made)])

    met = coded.groupBy("x_row").applyInArrow(join, T.StructType([fields[0], *fields[2:-1], *made]))
    met = met.join(chunks.where("x_k = 0").select("x_row", "x_rest"), "x_row")
    met = met.select(*[F.col("x_text").alias(c) if c == f"c{at}" else F.col(f"x_rest.{c}").alias(c) for c in inner.fieldNames() if keep_text or c != f"c{at}"], *MADE[: len(made)])
    return short.unionByName(met).toDF(*last)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs and a binary column of the concatenated bytes of each row's ids; null ids give no bytes."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks_path)
        for batch in batches:
            raw = [decode_ids(words, x.as_py() or b"") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "x_raw"])

    return inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("x_raw", T.BinaryType())])).toDF(*names, own_name(names, decoded))


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all but the text, if none are named), n_tokens, ids_sha256 and decoded_sha256 of each text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    ids, raw = own_name(docs.columns, "ids"), own_name(docs.columns, "decoded")
    coded = encode(docs.select(*dict.fromkeys([*keep, text])), ranks_path, pattern, text, ids, decoded=raw, keep_text=text in keep)
    return coded.select(
        *keep,
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(raw), 256).alias("decoded_sha256"),
    )
