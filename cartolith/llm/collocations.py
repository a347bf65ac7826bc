"""Collocations: phrases of words that keep each other's company, by suffix automata of shards.

A shard is a run of whole pieces of one task's texts, SHARD words or a text more. Its generalised suffix automaton is
bounded at a depth of LONGEST words: a state is a set of phrases that end at the same places, each the end of the next
longer one; it has the number of those places (endpos), the length of its longest phrase, and a suffix link to the state
of the longest end that occurs at more places. States are built level by level from sorted numbers: words that end a phrase,
then those with one more word before them, so that no word of a shard costs a Python call. A state's phrases are those
longer than its link's; they are listed with the state's count, and groupBy adds the counts of all shards.

Two rounds count: phrases of one and two words first, then longer ones, whose states grow backwards only over pairs of words
that all shards together have often enough. A filter of at most FILTER_BITS bits says so, as a phrase can't be more frequent than its
pairs; it may let others through, which the count drops then. Beyond its size it lets more through and loses nothing.

A candidate falls to a longer one with as many places. As counts only shrink from a phrase to a longer one, it is enough
to follow links of one word, off the front (a suffix link) and off the back (its mirror image).

Null texts are empty, a null language is `und`. Rows that repeat count as often as they come; an empty table has no rows.
Columns other than the text and the language aren't read, whatever their names. A text is whole in one task, as is its
list of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import drop_written, small_batches, spread_join, written

#: Words of a phrase at most, its least frequency, and the words of a shard.
LONGEST, LEAST, SHARD = 5, 100, 600_000
#: Phrases that are returned of a language.
TOP = 2000
#: Bits of the filter of pairs for each of them, and at most in all (32 MB).
PAIR_BITS, FILTER_BITS = 16, 1 << 28
#: Ranks are found among so many parts of a language first.
PARTS = 32
_BREAK = b"\xff"  # a byte that UTF-8 never has
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + 10 * _BREAK + b" ")


def words_of(text: str) -> list[bytes]:
    """Lower-case words in order, with _BREAK between pieces."""
    return text.encode().translate(_PLAIN).replace(_BREAK, b" \xff ").split(b" ")


class Words:
    """Numbers from 1 on for the words of each language; 0 is a break."""

    def __init__(self) -> None:
        self.next = count(1).__next__
        self.of: dict[str, defaultdict[bytes, int]] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        known = self.of.get(lang)
        if known is None:
            known = self.of[lang] = defaultdict(self.next)
            known[_BREAK] = 0
        found = [w for w in words_of(text) if w]
        numbers = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        self.held += [numbers, np.zeros(1, np.int32)]
        self.size += len(found) + 1

    def names(self) -> tuple[pa.Array, pa.Array]:
        """The word and the language of each number; those of 0 are not used."""
        n = sum(len(k) - 1 for k in self.of.values()) + 1
        at = np.zeros(n, np.int64)
        words, langs, place = [b""], [""], 1
        for lang, known in self.of.items():
            for word, i in known.items():
                if i:
                    at[i] = place
                    words.append(word)
                    langs.append(lang)
                    place += 1
        return pa.array(words, pa.binary()).take(pa.array(at)), pa.array(langs, pa.string()).dictionary_encode().take(pa.array(at))

    def numbers(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int32), *self.held]).astype(np.int64)


@dataclass
class Level:
    """The phrases of one length: how often each occurs, the phrase that it has one word before, and that word."""

    count: np.ndarray
    parent: np.ndarray
    word: np.ndarray


@dataclass
class Automaton:
    """States by number: endpos count, length of the longest phrase, the level's row of it, and the suffix link's length."""

    levels: list[Level]
    count: np.ndarray
    length: np.ndarray
    row: np.ndarray
    link_length: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, depth: int, open_pair=None) -> Automaton:
        """open_pair: of words and the words before them, which pairs phrases may grow over."""
        size = int(words.max(initial=0)) + 1
        at = np.flatnonzero(words)
        own, keys = words[at], words[at]
        levels: list[Level] = []
        for k in range(depth):
            distinct, rows, counts = np.unique(keys, return_inverse=True, return_counts=True)
            levels.append(Level(counts, distinct // size if k else np.zeros(len(distinct), np.int64), distinct % size))
            if k == depth - 1 or not len(at):
                break
            before = words[at - 1 - k]
            goes = before > 0
            if open_pair is not None:
                after = own if k == 0 else words[at - k]
                goes[goes] = open_pair(after[goes], before[goes])
            at, own, keys = at[goes], own[goes], rows[goes] * size + before[goes]
        counts, length, row, link = [], [], [], []
        above = np.zeros(size, np.int64)  # of each row of the level before: the length that its state's link has
        for k, level in enumerate(levels):
            longer = levels[k + 1] if k + 1 < len(levels) else None
            if k:  # a phrase with as many places as its parent is in one state with it
                same = level.count == levels[k - 1].count[level.parent]
                above = np.where(same, above[level.parent], k)
            else:
                above = np.zeros(len(level.count), np.int64)
            top = np.ones(len(level.count), bool)
            if longer is not None:
                top[longer.parent[longer.count == level.count[longer.parent]]] = False
            rows = np.flatnonzero(top)
            counts.append(level.count[rows])
            length.append(np.full(len(rows), k + 1))
            row.append(rows)
            link.append(above[rows])
        return cls(levels, *map(np.concatenate, (counts, length, row, link)))

    def phrases(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from least on: the words of all phrases of it, one column a word, and their counts.

        Each state gives the ends of its longest phrase that are longer than its link's.
        """
        for size in range(least, len(self.levels) + 1):
            mine = np.flatnonzero((self.length >= size) & (self.link_length < size))
            if not len(mine):
                continue
            row, columns = self.row[mine].copy(), []
            for k in range(len(self.levels), 0, -1):
                deep = self.length[mine] >= k
                if k <= size:
                    columns.append(self.levels[k - 1].word[row])
                row[deep] = self.levels[k - 1].parent[row[deep]]
            yield np.stack(columns, axis=1), self.count[mine]


def _hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of words' hashes, in this order."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of so many bits, a power of two."""
    return (hashes & np.uint64(bits - 1)).astype(np.int64), (hashes >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """The bits, eight a byte, of a filter of (lang, phrase of two words). Its size has a bound, so it is gathered."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << (PAIR_BITS * pairs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = [(lang, *phrase.encode().split(b" ")) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            first, second = (np.array([_word_hash(t[0], t[k]) for t in two], np.uint64) for k in (1, 2))
            at = np.unique(np.concatenate(_places(_hash(first, second), bits)))
            masks = np.left_shift(np.int64(1), at & 63)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(masks)], ["word", "mask"])

    longs = pairs.select("lang", "phrase").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[longs.column("word").to_numpy()] = longs.column("mask").to_numpy()
    return out.view(np.uint8)


def _counted(first: int, last: int, filter_=None):
    """(lang, phrase, size, f) of the phrases of a shard, of first to last words; a size of 0 counts a language's words."""

    def rows(shard: Words) -> Iterator[pa.RecordBatch]:
        words, langs = shard.names()
        open_pair = None
        if filter_ is not None:
            hashes = np.zeros(len(words), np.uint64)
            for lang, known in shard.of.items():
                for word, i in known.items():
                    hashes[i] = _word_hash(lang, word)
            bits = filter_.value

            def open_pair(after: np.ndarray, before: np.ndarray) -> np.ndarray:
                a, b = _places(_hash(hashes[before], hashes[after]), len(bits) * 8)
                return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

        automaton = Automaton.build(shard.numbers(), last, open_pair)
        if first == 1:
            level = automaton.levels[0]
            total = pa.table({"lang": langs.take(pa.array(level.word)).cast(pa.string()), "n": level.count}).group_by("lang").aggregate([("n", "sum")])
            n = len(total)
            yield pa.RecordBatch.from_arrays([total.column("lang").combine_chunks(), pa.array([""] * n), pa.array([0] * n, pa.int32()), total.column("n_sum").combine_chunks()], ["lang", "phrase", "size", "f"])
        for columns, counts in automaton.phrases(first):
            for at in range(0, len(counts), 1 << 16):
                part = columns[at : at + (1 << 16)]
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(part[:, k])) for k in range(part.shape[1])), pa.scalar(b" ", pa.binary())).cast(pa.string())
                lang = langs.take(pa.array(part[:, 0])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(part), part.shape[1], np.int32)), pa.array(counts[at : at + (1 << 16)].astype(np.int64))], ["lang", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Words()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(lang.as_py(), text.as_py() or "")
                if shard.size >= SHARD:
                    yield from rows(shard)
                    shard = Words()
        if shard.size:
            yield from rows(shard)

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to longest words that occur least times, and (lang, n) of all languages with words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    schema = "lang string, phrase string, size int, f bigint"

    def total(counted: DataFrame) -> DataFrame:
        return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))

    short = written(total(texts.mapInArrow(_counted(1, min(2, longest)), schema)), "pairs")
    found = short.where("size > 0")
    if longest > 2:
        sent = docs.sparkSession.sparkContext.broadcast(pair_filter(short.where("size = 2")))
        found = found.unionByName(total(texts.mapInArrow(_counted(3, longest, sent), schema)))
    phrases = written(found, "phrases")
    totals = written(short.where("size = 0").select("lang", F.col("f").alias("n")), "totals")
    drop_written(short)
    return phrases, totals


def _without(words: Column, first: int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def maximal(phrases: DataFrame) -> DataFrame:
    """The candidates, phrases of two words or more, that no longer one has all places of."""
    candidates = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    longer = phrases.where("size > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(_without(words, 2, F.col("size") - 1), _without(words, 1, F.col("size") - 1))).alias("phrase"))
    return candidates.join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the maximal candidates, by their lowest-scoring cut.

    Words that very many phrases begin or end with are dealt over several tasks.
    """
    words = F.split("phrase", " ")
    size = F.size("words")
    cuts = maximal(phrases).withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = written(cuts.select("lang", "phrase", "a", "k", _without(F.col("words"), 1, F.col("k")).alias("x_left"), _without(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("x_right")), "cuts")
    total = cuts.count()
    known = phrases.select("lang", "phrase", "f")
    out = cuts
    for side, name in (("x_left", "l"), ("x_right", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count("*").alias("x_n"))
        right = uses.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        out = spread_join(out, right, ["lang", side], "x_n", total, F.xxhash64("lang", "phrase", "k"))
    big = "decimal(38,0)"
    n = F.col("n").cast("decimal(19,0)")
    out = out.join(totals, "lang").withColumn("x_top", (F.col("a").cast("decimal(15,0)") * n * 1000).cast(big)).withColumn("x_under", (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(18,0)")).cast(big))
    out = out.withColumn("score", F.expr("x_top div x_under"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("x")
    out = out.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), least)
    return out.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows by score, frequency and phrase; first those of PARTS parts, then those of the parts' first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = rows.withColumn("x_part", part).withColumn("x_rank", F.row_number().over(Window.partitionBy("lang", "x_part").orderBy(*order))).where(F.col("x_rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return ranked(scored(*frequent_phrases(docs, text, lang)))


ORACLE = r"""WITH x_pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
x_words AS MATERIALIZED (SELECT lang, row_number() OVER () AS x_row, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM x_pieces),
x_n AS MATERIALIZED (SELECT lang, sum(len(w)) AS n FROM x_words GROUP BY lang),
x_places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM x_words),
x_grams AS (SELECT lang, list_slice(w, i, i + k - 1) AS g FROM x_places, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
x_f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM x_grams GROUP BY lang, g HAVING count(*) >= 100),
x_longer AS (SELECT lang, g, f, unnest([list_slice(g, 2, len(g)), list_slice(g, 1, len(g) - 1)]) AS s FROM x_f WHERE len(g) > 2),
x_kept AS (SELECT lang, g, f AS a FROM x_f x WHERE len(g) > 1 AND NOT EXISTS (SELECT 1 FROM x_longer y WHERE y.lang = x.lang AND y.s = x.g AND 100 * y.f >= 100 * x.f)),
x_cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM x_kept),
x_scored AS (SELECT c.lang, c.g, c.a, k, y.f AS l, z.f AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(y.f AS HUGEINT) * z.f) AS score
    FROM x_cuts c JOIN x_f y ON y.lang = c.lang AND y.g = list_slice(c.g, 1, k) JOIN x_f z ON z.lang = c.lang AND z.g = list_slice(c.g, k + 1, len(c.g)) JOIN x_n m ON m.lang = c.lang),
x_least AS (SELECT *, array_to_string(g, ' ') AS phrase FROM x_scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x_ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x_least)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM x_ranked WHERE rank <= 2000"""
