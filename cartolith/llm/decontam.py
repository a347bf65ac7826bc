"""Benchmark decontamination with an FM-index per shard of the training texts.

Words are those of the benchmark rule: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. A window is
13 consecutive words of an item, or all words of a shorter one. A shard is a part of a task's rows. In it, runs of
words that some item has are the only places where a window can occur, and only runs as long as the shortest window;
these runs, with a separator between them, are indexed. All windows are searched backward together, their occurrences
located by sampled suffix positions, and the spans of one row merged.

Texts need no shuffle, and no row depends on another. Items go to the executors in blocks of bounded size; a larger
benchmark takes more passes over the rows, which are written between them, so that a task never holds two blocks. Runs longer than a shard are cut with an overlap of a window
less one word.

Null or empty texts have no words and are clean, null or empty items have no windows. Rows that repeat are judged
alike; items that share an id count as one, a null id is "null".
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import own_name, written
from cartolith.llm.fmindex import FMIndex
from cartolith.llm.textblocks import ALNUM, column_bytes, hash_words, row_blocks

WINDOW = 13
#: Symbols of a shard, bytes of text worked on together, bytes of items in a block.
SHARD, BLOCK, ITEMS = 1 << 19, 2 << 20, 16 << 20
SPANS = "array<struct<start:bigint,end:bigint>>"


class Windows:
    """The windows of items: symbols by word, phrases, and the items of each phrase.

    A phrase is a place in the stream of all items' symbols. Arrays hold all of it: some 50 bytes a word of the items.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = column_bytes(column)
        hashes, counts = hash_words(data, offsets, ALNUM)
        self.words = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words >> np.uint64(48)).astype(np.int64)] = True
        self.stream = (np.searchsorted(self.words, hashes) + 1).astype(np.int32)
        ends = np.cumsum(counts)
        size = np.minimum(counts, window)
        many = np.where(size > 0, counts - size + 1, 0)
        del hashes, data
        owner = np.repeat(np.arange(len(items), dtype=np.int32), many)
        start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - ends + counts, many)
        length = size[owner].astype(np.int32)
        order, first = self._groups(start, length)
        self.starts, self.lengths = start[order[first]], length[order[first]]
        self.held, self.cuts = owner[order], np.append(first, len(order))
        self.ids = [i for i, _ in items]
        self.shortest = int(self.lengths.min(initial=window))
        self.window = window

    def _groups(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows in an order that has equal ones side by side, and where each group of equal ones begins in it."""
        factor = np.uint64(0x9E3779B97F4A7C15)
        while True:
            key = np.empty(len(start), np.uint64)
            for at in range(0, len(start), SHARD):
                begin, size = start[at : at + SHARD], length[at : at + SHARD]
                part = size.astype(np.uint64)
                for k in range(int(size.max())):
                    here = np.flatnonzero(k < size)
                    part[here] = part[here] * factor + self.stream[begin[here] + k].astype(np.uint64)
                key[at : at + SHARD] = part
            order = np.argsort(key, kind="stable").astype(np.int32)
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.diff(key[order]) != 0
            if all(self._equal(start, length, order[np.maximum(old - 1, 0)], order[old]) for old in (at + np.flatnonzero(~fresh[at : at + SHARD]) for at in range(0, len(order), SHARD))):
                return order, np.flatnonzero(fresh)
            factor = factor * np.uint64(0xD6E8FEB86659FD93)  # unlike windows met at one key: other keys

    def _equal(self, start: np.ndarray, length: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
        """Whether windows on the left are those on the right, word by word."""
        size = length[right]
        if (length[left] != size).any():
            return False
        a, b = start[left], start[right]
        return all((self.stream[a[here] + k] == self.stream[b[here] + k]).all() for k in range(int(size.max(initial=0))) for here in (np.flatnonzero(k < size),))

    def owners(self, phrase: int) -> np.ndarray:
        """The items that have a phrase, repeated where they have it several times."""
        return self.held[self.cuts[phrase] : self.cuts[phrase + 1]]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's symbol, 0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
        out[near] = np.where(self.words[at] == hashes[near], at + 1, 0)
        return out

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word positions among hashes, words covered, phrases) of all occurrences, a shard at a time."""
        if not len(self.lengths) or not len(hashes):
            return
        symbol = self.symbols(hashes)
        known = symbol > 0
        first, last = known.copy(), known.copy()
        first[1:] &= ~known[:-1]
        last[:-1] &= ~known[1:]
        rows = np.cumsum(counts)[:-1]
        rows = rows[(rows > 0) & (rows < len(hashes))]
        first[rows], last[rows - 1] = known[rows], known[rows - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        parts: list[tuple[int, int]] = []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            while b - a > SHARD:
                parts.append((a, a + SHARD))
                a += SHARD - self.window + 1
            parts.append((a, b))
        at = 0
        while at < len(parts):
            text, origin, size = [], [], 0
            while at < len(parts) and (not text or size + parts[at][1] - parts[at][0] <= SHARD):
                a, b = parts[at]
                text += [symbol[a:b], [len(self.words) + 1]]
                origin += [np.arange(a, b), [-1]]
                size += b - a + 1
                at += 1
            index, place = FMIndex(np.concatenate(text), len(self.words) + 1), np.concatenate(origin)
            near = self._within(np.concatenate(text))
            low, high = index.search(self.stream, self.starts[near], self.lengths[near])
            many = np.maximum(high - low, 0)
            suffix = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            which = np.repeat(near, many)
            yield place[index.locate(suffix)], self.lengths[which], which

    def _within(self, shard: np.ndarray) -> np.ndarray:
        """The phrases all of whose words are in a shard; others can't occur there, and aren't searched for."""
        there = np.zeros(len(self.words) + 2, bool)
        there[shard] = True
        have = np.concatenate([[0], np.cumsum(there[self.stream], dtype=np.int32)])
        return np.flatnonzero(have[self.starts + self.lengths] - have[self.starts] == self.lengths)


@functools.lru_cache(maxsize=1)
def _windows(held: Broadcast, window: int) -> Windows:
    """The windows of a block of items, kept while a worker's tasks have the same block."""
    return Windows(held.value, window)


def _merge(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    order = np.argsort(begin, kind="stable")
    begin, top = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > top[:-1]])
    cuts = np.flatnonzero(new)
    return [{"start": int(a), "end": int(b)} for a, b in zip(begin[cuts], top[np.append(cuts[1:] - 1, len(top) - 1)], strict=True)]


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most so many bytes (a larger one is alone), by id and text."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().orderBy("i", "t")
    block, size = [], 0
    for row in rows.toLocalIterator():
        more = len(row.t.encode())
        if block and size + more > most:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += more
    yield block


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """docs, each text's number of words, merged spans of hit words and sorted ids of the items with windows in it."""
    kept = docs.columns
    at = kept.index(text)
    out = docs.toDF(*[f"c{i}" for i in range(len(kept))]).withColumns({"x_n": F.lit(0).cast("bigint"), "x_spans": F.lit(None).cast(SPANS), "x_items": F.lit(None).cast("array<string>")})
    for k, block in enumerate(_blocks(items, item_id, item_text, ITEMS)):
        if k:
            out = written(out, "marked")  # so that a task holds one block's windows
        held = docs.sparkSession.sparkContext.broadcast(block)  # of at most ITEMS bytes, or one item

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = _windows(held, window)
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                words = np.zeros(len(batch), np.int64)
                spans, found = batch.column(-2).to_pylist(), batch.column(-1).to_pylist()
                for a, b in row_blocks(offsets, BLOCK):
                    hashes, counts = hash_words(data, offsets[a : b + 1], ALNUM)
                    words[a:b] = counts
                    base = np.concatenate([[0], np.cumsum(counts)])
                    for begin, size, which in windows.find(hashes, counts):
                        row = np.searchsorted(base, begin, "right") - 1
                        order = np.argsort(row, kind="stable")
                        cuts = np.flatnonzero(np.diff(row[order])) + 1
                        for part in np.split(order, cuts) if len(order) else ():
                            r = int(row[part[0]])
                            here = begin[part] - base[r]
                            old = spans[a + r] or []
                            spans[a + r] = _merge(np.concatenate([here, [x["start"] for x in old]]).astype(np.int64), np.concatenate([here + size[part], [x["end"] for x in old]]).astype(np.int64))
                            ids = {windows.ids[i] for k in np.unique(which[part]) for i in np.unique(windows.owners(k))}
                            found[a + r] = sorted(ids | set(found[a + r] or ()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-3], pa.array(words), pa.array(spans, batch.schema.types[-2]), pa.array(found, pa.list_(pa.string()))], batch.schema.names
                )

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields]))
    return out.select(*[c for c in out.columns[:-3]], "x_n", F.coalesce("x_spans", F.array().cast(SPANS)), F.coalesce("x_items", F.array().cast("array<string>"))).toDF(*kept, *names)


def hits(spans: Column) -> Column:
    """The number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = mark(docs.select("doc_id", "text"), items).withColumn("n_hit", hits(F.col("hit_spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    n, spans, ids = (own_name(docs.columns, x) for x in ("n_words", "hit_spans", "hit_items"))
    out = mark(docs, items, names=(n, spans, ids))
    return out.where(~contaminated(F.col(n), hits(F.col(spans)))).drop(n, spans, ids)
