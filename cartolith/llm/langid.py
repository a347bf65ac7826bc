"""Language identification by unigrams of pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary (all of its byte-level ranks, and all single
bytes). A word's probability is the sum over all its segmentations of the product of their pieces' probabilities, by a
forward pass; a text's is the product over its words. Words are runs of letters (a-z after lower-casing A-Z, and all
that is not ASCII) of any length, with a leading space, as the vocabulary has them.

Training is expectation-maximisation from the uniform distribution. Spark counts each distinct word in each language
once, in a table; a step is a forward-backward pass over that table, which gives the expected number of each piece.
A model has pieces x languages numbers, whatever the corpus; more than MOST_LANGUAGES languages are an error.

A task scores a word once while it stays in a cache of fixed size. Null texts and texts without any letter are "und"
with score 0; so are all texts if there is nothing to learn from. Ties go to the language that sorts first. Repeated
rows are told alike, and each counts in training. Other columns are kept; where one has a new column's name, the new
one gets a leading underscore.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import own_name, written
from cartolith.llm.textblocks import LETTERS, LOWER, column_bytes, hash_words, row_blocks

#: Bytes of text that are worked on together.
BLOCK = 1 << 20
#: Numbers (words x bytes x languages) of a batch of words; so many bytes at most are kept as scores of known words.
CELLS, CACHE = 1 << 20, 16 << 20
#: A batch of fewer words goes word by word, over the edges that there are.
FEW = 8
MOST_LANGUAGES = 1000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary as a trie of its pieces read backward: hashes of all their endings, with a piece's number or -1."""

    BITS = 20

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            words = [base64.b64decode(a) for a, _ in map(bytes.split, lines)]
        self.words = sorted({w for w in words if w and b"\0" not in w} | {bytes([i]) for i in range(1, 256)})
        self.longest = max(map(len, self.words))
        ends: dict[int, int] = {}
        mask, step = (1 << 64) - 1, int(_STEP)
        for i, w in enumerate(self.words):
            key = 0
            for byte in reversed(w):
                key = (key * step + byte + 1) & mask
                ends.setdefault(key, -1)
            ends[key] = i
        self.slots = np.full(1 << self.BITS, -2, dtype=np.int32)
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        keys = np.fromiter(ends, np.uint64, len(ends))
        self.probes = 0
        for key, at, i in zip(keys.tolist(), self._slot(keys).tolist(), ends.values(), strict=True):
            probe = 0
            while self.slots[at] != -2:
                at, probe = (at + 1) & ((1 << self.BITS) - 1), probe + 1
            self.slots[at], self.keys[at] = i, key
            self.probes = max(self.probes, probe)

    def __len__(self) -> int:
        return len(self.words)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pieces, -1 for endings of pieces only, -2 for what is none."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.slots[at], -2)
        left = np.flatnonzero((self.keys[at] != keys) & (self.slots[at] != -2))
        for probe in range(1, self.probes + 1):
            if not len(left):
                break
            near = (at[left] + probe) & ((1 << self.BITS) - 1)
            hit = self.keys[near] == keys[left]
            out[left[hit]] = self.slots[near[hit]]
            left = left[~hit & (self.slots[near] != -2)]
        return out


@functools.lru_cache(maxsize=2)
def pieces(ranks_path: str) -> Pieces:
    return Pieces(ranks_path)


def edges(words: np.ndarray, vocabulary: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces) by rising end. words: a row of bytes each, filled up with zeros behind a word's end."""
    n, length = words.shape
    for end in range(1, length + 1):
        rows, key = np.arange(n), np.zeros(n, np.uint64)
        for begin in range(end - 1, max(-1, end - 1 - vocabulary.longest), -1):
            key = key * _STEP + words[rows, begin].astype(np.uint64) + np.uint64(1)
            found = vocabulary.find(key)
            have = found >= 0
            if have.any():
                yield begin, end, rows[have], found[have]
            alive = found != -2
            if not alive.all():
                rows, key = rows[alive], key[alive]
                if not len(rows):
                    break


def word_edges(word: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, piece) of one word's edges, by rising end and then falling start."""
    ends, key, out = np.arange(1, len(word) + 1, dtype=np.int32), np.zeros(len(word), np.uint64), []
    for size in range(1, vocabulary.longest + 1):
        inside = ends >= size
        ends, key = ends[inside], key[inside]
        if not len(ends):
            break
        key = key * _STEP + word[ends - size].astype(np.uint64) + np.uint64(1)
        found = vocabulary.find(key)
        have = found >= 0
        out.append((ends[have] - size, ends[have], found[have]))
        ends, key = ends[found != -2], key[found != -2]
    begin, end, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    del out
    order = np.lexsort((-begin, end))
    return begin[order], end[order], ids[order]


def _forward_one(word: np.ndarray, vocabulary: Pieces, table: np.ndarray) -> np.ndarray:
    """Logarithm of a word's probability; table: pieces by languages. Sums are kept for the longest piece's bytes only."""
    begin, end, ids = word_edges(word, vocabulary)
    cuts = np.searchsorted(end, np.arange(1, len(word) + 2))
    kept = vocabulary.longest + 1
    at, scale = np.zeros((kept, table.shape[1])), np.zeros(table.shape[1])
    at[0] = 1
    begin %= kept
    for e in range(1, len(word) + 1):
        part = slice(cuts[e - 1], cuts[e])
        at[e % kept] = (at[begin[part]] * table[ids[part]]).sum(axis=0)
        if e % 8 == 0:
            top = at[e % kept].copy()
            with np.errstate(over="ignore"):  # what lies far back may pass a double's range
                np.minimum(at / top, 1e280, out=at)
            scale += np.log(top)
    return np.log(at[len(word) % kept]) + scale


def _expected_one(word: np.ndarray, vocabulary: Pieces, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected number) of one word's edges; logs: of one language's pieces. All is held in flat arrays."""
    begin, end, ids = word_edges(word, vocabulary)
    gain, size = logs[ids], len(word)
    cuts = np.searchsorted(end, np.arange(1, size + 2))
    fore, back = np.zeros(size + 1), np.zeros(size + 1)
    for e in range(1, size + 1):
        part = slice(cuts[e - 1], cuts[e])
        fore[e] = np.logaddexp.reduce(fore[begin[part]] + gain[part])
    order = np.argsort(begin, kind="stable")
    cuts = np.searchsorted(begin, np.arange(size + 1), sorter=order)
    back[size], last = 0, len(order)
    for b in range(size - 1, -1, -1):
        part = order[cuts[b] : last]
        last = cuts[b]
        back[b] = np.logaddexp.reduce(gain[part] + back[end[part]])
    gain += fore[begin]
    gain += back[end]
    gain -= fore[size]
    return ids, np.exp(gain, out=gain)


def forward(words: np.ndarray, vocabulary: Pieces, prob: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each word in each language. words: as for edges(); size: bytes of each (default: all);
    prob: languages by pieces, without zeros."""
    n, length = words.shape
    size = np.full(n, length) if size is None else size
    table = np.ascontiguousarray(prob.T)
    if n < FEW and length > 64:
        return np.stack([_forward_one(w[:s], vocabulary, table) for w, s in zip(words, size.tolist(), strict=True)])
    at = np.zeros((length + 1, n, prob.shape[0]))
    at[0] = 1
    out, scale, done = np.zeros((n, prob.shape[0])), np.zeros((n, prob.shape[0])), 0

    def finish(end: int) -> None:
        """Notes words that end here, and every eight bytes sets the values from which later ones are reached to scale."""
        over = np.flatnonzero(size == end)
        out[over] = np.log(at[end][over]) + scale[over]
        if end % 8 == 0:
            top = np.where(at[end] > 0, at[end], 1)
            at[max(0, end - vocabulary.longest) : end + 1] /= top
            scale[:] += np.log(top)

    for begin, end, rows, ids in edges(words, vocabulary):
        if end != done:
            if done:
                finish(done)
            done = end
        at[end][rows] += at[begin][rows] * table[ids]
    if done:
        finish(done)
    return out


def expected(words: np.ndarray, vocabulary: Pieces, prob: np.ndarray, lang: np.ndarray, weight: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Expected number of each piece in each language; lang, weight: each word's language, and how often it occurs in it.

    Passes run on logarithms, so that words of any length keep all their segmentations.
    """
    n, length = words.shape
    size = np.full(n, length) if size is None else size
    logs = np.log(prob)
    if n < FEW and length > 64:
        out = np.zeros(prob.shape)
        for r in range(n):
            ids, share = _expected_one(words[r, : size[r]], vocabulary, logs[lang[r]])
            out[lang[r]] += np.bincount(ids, share, minlength=prob.shape[1]) * weight[r]
        return out
    found = list(edges(words, vocabulary))
    fore, back = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    fore[0] = 0
    back[size, np.arange(n)] = 0
    gains = [logs[lang[rows], ids] for _, _, rows, ids in found]
    for (begin, end, rows, _), gain in zip(found, gains, strict=True):
        fore[end][rows] = np.logaddexp(fore[end][rows], fore[begin][rows] + gain)
    for (begin, end, rows, _), gain in sorted(zip(found, gains, strict=True), key=lambda e: -e[0][1]):
        back[begin][rows] = np.logaddexp(back[begin][rows], back[end][rows] + gain)
    total = fore[size, np.arange(n)]
    shares = [np.exp(fore[begin][rows] + gain + back[end][rows] - total[rows]) * weight[rows] for (begin, end, rows, _), gain in zip(found, gains, strict=True)]
    spots = np.concatenate([lang[rows] * prob.shape[1] + ids for _, _, rows, ids in found])
    return np.bincount(spots, np.concatenate(shares), minlength=prob.size).reshape(prob.shape)


def _batches(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in begin, matrix of the words' bytes with a leading space, their sizes) for words of like length."""
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        least = int(size[order[a]])
        b = int(np.searchsorted(size[order], least + least // 8, "right"))
        b = min(b, a + max(1, CELLS // (width * (least + least // 8 + 2))))
        part = order[a:b]
        longest = int(size[part].max())
        out = np.zeros((len(part), longest + 1), np.uint8)
        out[:, 0] = 32
        inside = np.arange(longest) < size[part][:, None]
        out[:, 1:][inside] = LOWER[data[(begin[part][:, None] + np.arange(longest))[inside]]]
        yield part, out, size[part] + 1
        a = b


class Cache:
    """Scores of words by their hash; a word takes the place of another with the same slot."""

    def __init__(self, width: int):
        self.bits = max(8, int(CACHE // (8 * (width + 1))).bit_length() - 1)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros((1 << self.bits, width))

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = self.slot(hashes)
        self.keys[at], self.values[at] = hashes, values


def distinct_words(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(word, lang, n): how often each distinct word occurs in each language. docs: text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            which = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for a, b in row_blocks(offsets, BLOCK):
                hashes, counts, begin, length = hash_words(data, offsets[a : b + 1], LETTERS, spans=True)
                lang = np.repeat(which[a:b], counts)
                _, first, n = np.unique(hashes * np.uint64(len(langs)) + lang.astype(np.uint64), return_index=True, return_counts=True)
                size = length[first]
                ends = np.concatenate([[0], np.cumsum(size)])
                spots = np.repeat(begin[first] - ends[:-1], size) + np.arange(ends[-1])
                words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[spots]])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(lang[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "lang", "n"])

    return docs.select("text", "lang").mapInArrow(run, "word binary, lang int, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, ranks_path: str, text: str = "text", lang: str = "lang", steps: int = 2, smoothing: float = 0.05) -> Model:
    """A model of the languages of docs; rows whose text or language is null take no part.

    smoothing: added to each piece's expected number, in shares of the mean number.
    """
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    langs = sorted(r.lang for r in docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = len(pieces(ranks_path))
    prob = np.full((len(langs), size), 1 / size)
    words = written(distinct_words(docs, langs), "words") if langs else None
    for _ in range(steps if langs else 0):
        held = docs.sparkSession.sparkContext.broadcast(prob)  # pieces x languages

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            vocabulary, prob = pieces(ranks_path), held.value
            total = np.zeros(prob.shape)
            for batch in batches:
                data, offsets = column_bytes(batch.column("word"))
                lang, n = batch.column("lang").to_numpy().astype(np.int64), batch.column("n").to_numpy().astype(np.float64)
                for part, matrix, sizes in _batches(data, offsets[:-1], np.diff(offsets), 8):
                    total += expected(matrix, vocabulary, prob, lang[part], n[part], sizes)
            at = np.nonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

        rows = words.mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(langs), size))
        counts[rows.column("lang").to_numpy(), rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
        counts += smoothing * counts.mean(axis=1, keepdims=True) + 1e-9
        prob = counts / counts.sum(axis=1, keepdims=True)
        held.unpersist()
    return Model(ranks_path, langs, prob)


@dataclass
class Model:
    ranks_path: str
    langs: list[str]
    prob: np.ndarray

    def predict(self, docs: DataFrame, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", outside: str | None = None) -> DataFrame:
        """docs and two columns: the likeliest language, and its posterior probability under equal priors.

        outside: a name for one more column: whether pieces drawn evenly explain the text better than any language.
        """
        names, langs, ranks_path = docs.columns, self.langs, self.ranks_path
        inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
        at = names.index(text)
        inner = inner.withColumn("x_letter", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False)))
        prob = self.prob if outside is None else np.vstack([self.prob, np.full((1, self.prob.shape[1]), 1 / self.prob.shape[1])])
        held = docs.sparkSession.sparkContext.broadcast(prob)  # pieces x languages
        width = len(prob) if langs else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, prob = pieces(ranks_path), held.value
            cache = Cache(max(1, width))
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                total = np.zeros((len(batch), width))
                for a, b in row_blocks(offsets, BLOCK) if width else ():
                    hashes, counts, begin, length = hash_words(data, offsets[a : b + 1], LETTERS, spans=True)
                    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    slots = cache.slot(distinct)
                    logs = cache.values[slots]
                    fresh = np.flatnonzero(cache.keys[slots] != distinct)
                    for part, matrix, sizes in _batches(data, begin[first[fresh]], length[first[fresh]], width):
                        logs[fresh[part]] = forward(matrix, vocabulary, prob, sizes)
                    cache.put(distinct[fresh], logs[fresh])
                    rows = np.concatenate([[0], np.cumsum(counts)])
                    sums = np.zeros((len(hashes) + 1, width))
                    np.cumsum(logs[inverse], axis=0, out=sums[1:])
                    total[a:b] = sums[rows[1:]] - sums[rows[:-1]]
                letter = batch.column("x_letter").to_numpy(zero_copy_only=False).astype(bool)
                beyond = np.zeros(len(batch), bool)
                if langs:
                    known = total[:, : len(langs)]
                    best, top = known.argmax(axis=1), known.max(axis=1)
                    odds = np.exp(known - top[:, None])
                    score_of = np.where(letter, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                    named = [langs[k] if y else "und" for k, y in zip(best.tolist(), letter.tolist(), strict=True)]
                    beyond = letter & (total[:, -1] > top)
                else:
                    score_of, named = np.zeros(len(batch)), ["und"] * len(batch)
                more = [pa.array(named, pa.string()), pa.array(score_of), *([pa.array(beyond)] if outside else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], *made])

        made = ["x_pred", "x_score", *(["x_outside"] if outside else [])]
        kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
        schema = T.StructType([*inner.schema.fields[:-1], *(T.StructField(m, k) for m, k in zip(made, kinds, strict=False))])
        extra = [own_name(names, c) for c in (lang_pred, score, *([outside] if outside else []))]
        return inner.mapInArrow(run, schema).toDF(*names, *extra)


def keep_identified(docs: DataFrame, ranks_path: str, learn: DataFrame) -> DataFrame:
    """The rows of docs in one of the languages of learn (text, lang), however short their texts are.

    Rejected are null texts, texts without a letter, and texts that pieces drawn evenly explain better than any language.
    """
    pred, score, outside = (own_name(docs.columns, c) for c in ("lang_pred", "score", "outside"))
    out = train(learn, ranks_path).predict(docs, "text", pred, score, outside)
    return out.where((F.col(pred) != "und") & ~F.col(outside)).drop(pred, score, outside)
