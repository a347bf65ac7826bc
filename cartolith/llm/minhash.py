"""MinHash near-duplicates with tensored banding, candidates confirmed on full shingle sets.

A set's sub-keys come from two small collections: M of them each, a sub-key being K minima. A table's key is a pair of
sub-keys, one of each collection, so M * M tables of 2K minima cost 2 * M * K minima only. A pair of sets meets in
some table just when it has a sub-key of the first collection and one of the second in common. With M = 12 and K = 3
that is 0.997 likely at a similarity of exactly 0.75, and 0.9999 at 0.85.

Steps, all of them on tables in the shared folder:
1. Each text becomes a row: the size of its set, 128 bits of digest, sub-keys, a 72-bit sketch.
2. Equal sets become one node; copies never make pairs. Nodes that share a doc_id are linked.
3. Sub-keys that only one node has are dropped before any pairs of sub-keys are formed.
4. Each bucket (key of a table) names a leader, and the others are compared with it alone. Components of the links so
   found are formed; a bucket whose nodes are all in one of them is done. Nodes of other buckets meet once more by
   sub-key, in blocks of at most 2 * GROUP: all that are outside the largest component of such a group are compared
   with the whole group, without ever making rows of pairs. Sizes and sketches rule out what cannot be similar (a pair
   of 0.75 is ruled out with a probability under 1e-4), and only links that join components leave a block.
5. A pair is a link only if its full sets confirm it.

Null and empty texts have no shingles and are components of their own. Rows that repeat are one document; so are rows
that share a doc_id, all of whose texts make links. A null doc_id is a component of its own, and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import drop_written, spread_join, written
from cartolith.llm.components import components
from cartolith.llm.textblocks import NOT_SPACE, column_bytes, hash_words, mix, row_blocks

WORDS, M, K = 5, 12, 3
PERCENT = 75
BLOCK = 2 << 20
#: Nodes of a block that are compared with another block's.
GROUP = 256
#: Bits of 2 * M * K in which sketches of a pair at the threshold differ: 9 expected, deviation 2.8.
SKETCH_DIFFERENCE = 20
#: So many ids at most are broadcast, 8 bytes each.
BROADCAST_IDS = 500_000
_FACTORS = mix(np.arange(1, 2 * M * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTED = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each row, as sorted 64-bit hashes."""
    hashes, counts = hash_words(data, offsets, NOT_SPACE)
    sums = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - words + 1
    if n > 0:
        for k in range(words):
            sums[:n] = sums[:n] * _SHIFTED + hashes[k : k + n]
        sums[:n] = mix(sums[:n])
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(sums[at : at + c - words + 1]))
        elif c:
            whole = np.array([c], np.uint64)
            for h in hashes[at : at + c]:
                whole = whole * _SHIFTED + h
            out.append(mix(whole ^ _SHIFTED))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """2 * M * K minima of each (not empty) set."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(_FACTORS)), np.uint64)
    step = max(1, len(sets) // max(1, len(flat) // (1 << 17)))
    for a in range(0, len(sets), step):  # parts that stay in the processor's cache
        b = min(len(sets), a + step)
        part = flat[begin[a] : begin[b] if b < len(sets) else len(flat)]
        for j, factor in enumerate(_FACTORS):
            out[a:b, j] = np.minimum.reduceat(part * factor, begin[a:b] - begin[a])
    return out


SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, s1 bigint, s2 bigint"


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of SIGNED for each row of docs; keys: M of the first collection, then M of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                sets = shingle_sets(data, offsets[a : b + 1])
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                d, s = np.zeros((b - a, 2), np.uint64), np.zeros((b - a, 2), np.uint64)
                keys: list = [[]] * (b - a)
                if len(some):
                    full = [sets[i] for i in some.tolist()]
                    flat, begin = np.concatenate(full), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    d[some, 0] = np.add.reduceat(mix(flat ^ _SHIFTED), begin)
                    d[some, 1] = np.add.reduceat(mix(flat + _SHIFTED), begin)
                    low = minima(full)
                    mixed = mix(low)
                    bits = (mixed & np.uint64(1)).astype(np.uint64)
                    for half, cols in ((0, slice(0, 64)), (1, slice(64, None))):
                        part = bits[:, cols]
                        s[some, half] = (part << np.arange(part.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    sub = np.zeros((len(some), 2 * M), np.uint64)
                    for k in range(K):
                        sub = mix(sub * _SHIFTED + mixed[:, k::K])
                    for i, row in zip(some.tolist(), sub.view(np.int64).tolist(), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *(pa.array(x.view(np.int64)[:, i].copy()) for x in (d,) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64())), *(pa.array(s.view(np.int64)[:, i].copy()) for i in (0, 1))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "s1", "s2"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) for all keys of tables in which a node may meet another. nodes: node, keys."""
    subs = nodes.select("node", F.posexplode("keys").alias("i", "value"))
    met = subs.groupBy("i", "value").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("i", "value")
    subs = subs.join(met, ["i", "value"], "left_semi")
    sides = subs.groupBy("node").agg(*(F.collect_list(F.when(cond, F.struct("i", "value"))).alias(side) for side, cond in (("left", F.col("i") < M), ("right", F.col("i") >= M))))
    pairs = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.xxhash64(x["i"], y["i"], x["value"], y["value"]))))
    keyed = sides.select("node", F.explode(pairs).alias("key"))
    many = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    return keyed.join(many, "key", "left_semi")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) with the sorted shingles' bytes. docs: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in row_blocks(offsets, BLOCK):
                sets = [s.tobytes() for s in shingle_sets(data, offsets[a : b + 1])]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles binary")


def _set(shingles: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(shingles.as_buffer(), np.uint64)


#: Pairs that one copy of a leader's set serves.
SERVED = 4096


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of node ids whose full sets are similar enough. pairs: u, v, salt.

    A node that leads very many pairs is joined by salt: its set is copied once for each salt that its pairs have.
    """
    salts = pairs.groupBy("u").agg(F.max("salt").alias("most"))
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s")).join(salts, "u").select("u", "s", F.explode(F.sequence(F.lit(0), "most")).alias("salt"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    both = pairs.join(left, ["u", "salt"]).join(right, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = _set(s), _set(t)
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "s", "t").mapInArrow(run, "u bigint, v bigint")


class _Forest:
    """Sets of numbers that grow together."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _block_links(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between rows of left and right that join their components."""
    node_l, node_r = left.column("node").to_numpy(), right.column("node").to_numpy()
    part_l, part_r = left.column("component").to_numpy(), right.column("component").to_numpy()
    sketch = [np.stack([t.column(c).to_numpy() for c in ("s1", "s2")], axis=1).view(np.uint64) for t in (left, right)]
    sets_l, sets_r = ([_set(s) for c in t.column("shingles").chunks for s in c] for t in (left, right))
    size_l, size_r = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_r])
    names, flat = np.unique(np.concatenate(sets_r), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size_r)[:-1]])
    forest, out = _Forest(), []
    for i, s in enumerate(sets_l):
        apart = np.bitwise_count(sketch[0][i] ^ sketch[1]).sum(axis=1)
        may = (part_r != part_l[i]) & (apart <= SKETCH_DIFFERENCE) & (np.minimum(size_r, size_l[i]) * 100 >= np.maximum(size_r, size_l[i]) * percent)
        if may.any():
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            mark = np.zeros(len(names), np.int64)
            mark[at[names[at] == s]] = 1
            common = np.add.reduceat(mark[flat], begin)
            for j in np.flatnonzero(may & (100 * common >= percent * (size_l[i] + size_r - common))).tolist():
                if forest.join(int(part_l[i]), int(part_r[j])):
                    out.append((int(node_l[i]), int(node_r[j])))
    return out


def group_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between components. rows: node, component, s1, s2, shingles and keys, of nodes that are still open."""
    narrow = rows.select("node", "component", F.posexplode(F.slice("keys", 1, M)).alias("i", "value"))
    counted = narrow.groupBy("i", "value", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sign"))
    groups = counted.groupBy("i", "value").agg(F.sum("n").alias("n"), F.sum("sign").alias("sign"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    once = groups.groupBy("n", "sign").agg(F.min(F.struct("i", "value", "main", "most")).alias("g")).select("g.i", "g.value", "g.main", F.ceil(F.col("n") / GROUP).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("g.most")) / GROUP).cast("int").alias("few_blocks"))
    placed = narrow.join(once, ["i", "value"]).withColumn("few", F.col("component") != F.col("main"))
    spot = F.xxhash64("node", F.lit(1))
    as_right = F.transform(F.sequence(F.lit(0), F.col("few_blocks") - 1), lambda p: F.struct(p.alias("p"), F.pmod(spot, F.col("all_blocks")).cast("int").alias("q"), F.lit(False).alias("left")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda q: F.struct(F.pmod(spot, F.col("few_blocks")).cast("int").alias("p"), q.alias("q"), F.lit(True).alias("left")))
    spread = placed.select("node", "few", "i", "value", F.explode(F.when((F.col("all_blocks") > 1) & F.col("few"), F.concat(as_right, as_left)).otherwise(as_right)).alias("at"))
    met = spread.select("node", "few", "at.left", F.xxhash64("i", "value", "at.p", "at.q").alias("group")).join(rows.select("node", "component", "s1", "s2", "shingles"), "node")
    dealt = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group")

    def solve(chunks: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        whole = pa.Table.from_batches(chunks)
        left = whole.filter(whole.column("left"))
        right = whole.filter(pa.compute.invert(whole.column("left")))
        left = left if len(left) else whole.filter(whole.column("few"))
        return _block_links(left, right, percent) if len(left) and len(right) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            links: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and group[a] != now:
                    links += solve(held)
                    held = []
                now = group[a]
                held.append(batch.slice(a, b - a))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])
        links = solve(held) if held else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    signed = written(signatures(docs, doc_id, text), "signatures")
    some = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    group = ["n_shingles", "d1", "d2"]
    first = some.groupBy(*group).agg(F.min(F.struct("doc_id", "keys", "s1", "s2")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(first.select(*group, "copies", F.col("first.doc_id").alias("node"), "first.keys", "first.s1", "first.s2"), "classes")
    nodes = classes.select("node", "n_shingles", "s1", "s2", "keys")
    repeated = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min(F.struct(*group)) != F.max(F.struct(*group))).alias("unlike")).where("n > 1")
    repeated = written(repeated, "repeated")
    again = not repeated.isEmpty()

    keyed = written(buckets(nodes), "buckets")
    ids = written(keyed.select("node").distinct(), "ids")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    met = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(near, "node", "left_semi")
    sets = written(full_sets(met.dropDuplicates(["node", "text"]) if again else met), "sets")

    leaders = keyed.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("u"), F.count(F.lit(1)).alias("n"))
    led = spread_join(keyed, leaders.withColumn("salts", F.ceil(F.col("n") / SERVED)), ["key"], "n", keyed.count()).where(F.col("u") != F.col("node"))
    pairs = led.select("u", F.col("node").alias("v"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("salts")).cast("int").alias("salt")).groupBy("u", "v").agg(F.min("salt").alias("salt"))
    links = confirm(written(pairs, "pairs"), sets, percent)
    if again:  # all texts of a doc_id are one document
        unlike = some.select("doc_id", *group).join(repeated.where("unlike").select("doc_id"), "doc_id", "left_semi").join(classes.select(*group, "node"), group)
        links = links.union(unlike.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct())
    links = written(links, "links")
    parts = components(links)

    now = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    open_nodes = now.join(open_keys, "key", "left_semi").select("node", "component").distinct()
    rows = written(open_nodes.join(nodes, "node").join(sets, "node"), "open")
    more = written(group_links(rows, percent), "links")
    if not more.isEmpty():
        parts = components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    for done in (keyed, ids, sets, links, rows, more, repeated):
        drop_written(done)

    # Rows of a class that is neither repeated nor linked are components of their own, as are rows without a set.
    whole = classes.select("node", "copies", *(F.col(c).alias(f"x_{c}") for c in group)).join(parts, "node", "left").where("copies > 1 or component is not null")
    whole = whole.select(*(f"x_{c}" for c in group), "copies", F.coalesce("component", "node").alias("component"))
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "n_shingles", *(F.when(known, F.col(c)).alias(f"x_{c}") for c in group))
    out = spread_join(out, whole, [f"x_{c}" for c in group], "copies", signed.count()).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _matched(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on doc_id; ids (x_id, written) is broadcast only if it is small."""
    right = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(right, docs["doc_id"] == right["x_id"], how)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near-duplicates; a null doc_id stays, a repeated one stays once."""
    found = near_duplicates(docs)
    named = found.where(F.col("doc_id").isNotNull())
    gone = written(named.where(~F.col("kept")).select(F.col("doc_id").alias("x_id")).distinct(), "gone")
    twice = written(named.groupBy(F.col("doc_id").alias("x_id")).count().where("count > 1").select("x_id"), "twice")
    out = _matched(docs, gone, "left_anti")
    if twice.isEmpty():
        return out
    return _matched(out, twice, "left_anti").unionByName(_matched(out, twice, "left_semi").dropDuplicates(["doc_id"]))
