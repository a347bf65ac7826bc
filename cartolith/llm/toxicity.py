"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. Lexicon. Whole words and word beginnings of 4 to 8 bytes (that end where a character does) are candidates. From
   labelled rows come the numbers of toxic and of other documents with each; those of the largest log-likelihood ratio,
   in LEAST_TOXIC toxic documents at least, make the lexicon of TERMS terms.
2. Voters. Each of the first VOTERS terms votes where it occurs, and again where it occurs twice; patterns (upper case,
   exclamation marks) and the annotator vote too.
3. Label model. In either class a voter votes with a probability of its own, given the vote of one other voter: the
   model is a forest over voters. Its edges are those of largest mutual information within the classes, as far as they
   say more than their parameters cost (Bayes' information criterion). All rates, the annotator's too, come from
   expectation-maximisation that begins at the annotator's votes. So voters that say the same, as a term and its
   beginnings, count about once.
4. Classifier. Logistic regression of the posteriors on term counts and patterns; it needs no label.

Fitting uses at most about `sample` labelled documents, chosen by a hash of doc_id, one text of each; the terms' counts,
the votes and the posteriors are all over that sample, so what reaches the driver is bounded by it. Scoring covers all
rows.

Null and empty texts have no terms and get the score of such a text. Without labelled rows of both classes all scores are
0. Rows that repeat are scored alike. A document with several labels is toxic if any says so; of several texts with one
doc_id the least is learned from. Other columns are kept; where one has the score's name, the score gets a leading
underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import in_share, own_name, written
from cartolith.llm.textblocks import LETTERS, column_bytes, hash_words, mix, row_blocks

HEADS = (4, 5, 6, 7, 8)
BLOCK = 2 << 20
SAMPLE, TERMS, VOTERS = 20_000, 256, 96
#: Terms of fewer toxic documents in the sample are none.
LEAST_TOXIC = 4
_SALTS = mix(np.arange(1, len(HEADS) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PATTERNS = 3


def _term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and its beginnings (a row each), and the words' rows. Beginnings that would be the whole word
    or would end within a character are none."""
    found = hash_words(data, offsets, LETTERS, spans=True, prefixes=HEADS)
    whole, counts, begin, length, heads = found[0], found[1], found[2], found[3], found[4:]

    def head(h: np.ndarray, size: int) -> np.ndarray:
        longer = np.flatnonzero(length > size)
        ends = longer[(data[begin[longer] + size] & 0xC0) != 0x80]
        out = np.zeros(len(h), np.uint64)
        out[ends] = h[ends]
        return out

    hashes = np.stack([whole ^ _SALTS[0], *(head(h, size) ^ s for h, s, size in zip(heads, _SALTS[1:], HEADS, strict=True))])
    return hashes, np.repeat(np.arange(len(counts)), counts)


def _patterns(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Upper case a letter, exclamation marks a word, and the logarithm of the number of words."""
    def count(low: int, high: int) -> np.ndarray:
        part = data[offsets[0] : offsets[-1]]
        at = np.flatnonzero((part >= low) & (part <= high)) + offsets[0]
        return np.diff(np.searchsorted(at, offsets))

    upper, lower = count(65, 90), count(97, 122)
    return np.stack([upper / np.maximum(1, upper + lower), np.minimum(1, count(33, 33) / np.maximum(1, words)), np.log1p(words) / 10], axis=1)


def candidates(rows: DataFrame) -> DataFrame:
    """(term, toxic, n): numbers of toxic documents and of all with each term. rows: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in row_blocks(offsets, BLOCK):
                hashes, row = _term_hashes(data, offsets[a : b + 1])
                for kind, salt in zip(hashes, _SALTS, strict=True):
                    _, first = np.unique(mix(kind + mix(row.astype(np.uint64))), return_index=True)
                    first = first[kind[first] != salt]
                    terms, inverse = np.unique(kind[first], return_inverse=True)
                    n = np.bincount(inverse, minlength=len(terms))
                    bad = np.bincount(inverse, toxic[a:b][row[first]], minlength=len(terms)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(n)], ["term", "toxic", "n"])

    return rows.select("text", "toxic").mapInArrow(run, "term bigint, toxic bigint, n bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def lexicon(rows: DataFrame, toxic: int, total: int, size: int = TERMS) -> np.ndarray:
    """The terms that are likelier in toxic documents, of largest log-likelihood ratio, as hashes in that order."""
    n, a = F.col("n").cast("double"), F.col("toxic").cast("double")

    def part(seen: Column, base: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / base)).otherwise(0.0)

    rate = toxic / total
    ratio = part(a, n * rate) + part(n - a, n * (1 - rate)) + part(toxic - a, (total - n) * rate) + part(total - toxic - n + a, (total - n) * (1 - rate))
    best = candidates(rows).where((F.col("toxic") >= LEAST_TOXIC) & (a > 2 * n * rate)).withColumn("ratio", F.round(ratio, 6)).orderBy(F.desc("ratio"), "term").limit(size)
    return np.array([r.term for r in best.select("term").collect()], np.int64).view(np.uint64)  # at most `size` rows


class Counter:
    """Counts the lexicon's terms in rows of text."""

    def __init__(self, terms: np.ndarray):
        self.order = np.argsort(terms)
        self.terms = terms[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(terms >> np.uint64(48)).astype(np.int64)] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts of each term, then patterns, for each row."""
        hashes, row = _term_hashes(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.terms)), np.float32)
        for kind in hashes if len(self.terms) else ():
            near = np.flatnonzero(self.maybe[(kind >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, kind[near]), len(self.terms) - 1)
            hit = self.terms[at] == kind[near]
            np.add.at(out, (row[near[hit]], self.order[at[hit]]), 1)
        return np.hstack([out, _patterns(data, offsets, np.bincount(row, minlength=n)).astype(np.float32)])


def votes(features: np.ndarray, gold: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    """0/1 votes: terms that occur, terms that occur twice, patterns, and the annotator as the last one."""
    counts = features[:, :-PATTERNS][:, :voters]
    upper, marks = features[:, -PATTERNS], features[:, -PATTERNS + 1]
    return np.hstack([counts >= 1, counts[:, : voters // 2] >= 2, (upper > 0.5)[:, None], (marks > 0.2)[:, None], gold[:, None] > 0]).astype(np.float64)


@dataclass
class LabelModel:
    """prior: of toxic; parent: of each voter, or -1; rates: chance of a vote, by class, the parent's vote, and voter."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of each row to be toxic."""
        said = np.where(self.parent >= 0, vote[:, self.parent], 0).astype(np.int64)
        logit = np.full(len(vote), np.log(self.prior / (1 - self.prior)))
        for j in range(vote.shape[1]):
            chance = self.rates[:, said[:, j], j]
            chance = np.where(vote[:, j] > 0, chance, 1 - chance)
            logit += np.log(chance[1] / chance[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _forest(vote: np.ndarray, post: np.ndarray, free: int) -> np.ndarray:
    """Parents in the forest of largest mutual information given the class; voters from `free` on have none."""
    n, m = vote.shape
    gain = np.zeros((m, m))
    for w in (1 - post, post):
        total = w.sum() + 1e-9
        one = np.clip(w @ vote / total, 1e-9, 1 - 1e-9)
        both = (vote * w[:, None]).T @ vote / total
        for a in (0, 1):
            for b in (0, 1):
                p = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                base = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
                p = np.maximum(p, 0)
                gain += total * np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / base), 0)
    gain -= np.log(max(2, n))  # an edge adds a rate in either class
    gain[free:], gain[:, free:] = -np.inf, -np.inf
    np.fill_diagonal(gain, -np.inf)
    parent, best, link, left = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1), np.ones(m, bool)
    for _ in range(m):
        j = int(np.where(left, best, -np.inf).argmax()) if (left & (best > 0)).any() else int(np.flatnonzero(left)[0])
        parent[j] = link[j] if best[j] > 0 else -1
        left[j] = False
        better = left & (gain[j] > best)
        best[better], link[better] = gain[j][better], j
    return parent


def label_model(vote: np.ndarray, steps: int = 15) -> tuple[LabelModel, np.ndarray]:
    """A model of 0/1 votes, and each row's posterior probability to be toxic. The last voter, the annotator, is where
    estimation begins; it depends on no other."""
    post = np.clip(vote[:, -1], 0.03, 0.97)
    model = None
    for step in range(steps):
        parent = _forest(vote, post, vote.shape[1] - 1) if model is None or step < 4 else model.parent
        said = np.where(parent >= 0, vote[:, parent], 0)
        rates = np.empty((2, 2, vote.shape[1]))
        for y, w in ((0, 1 - post), (1, post)):
            alone = (w @ vote + 0.1) / (w.sum() + 1)
            for a in (0, 1):
                here = w[:, None] * (said == a)
                # one row's worth of the voter's own rate, so that rare cases have some
                rates[y, a] = ((here * vote).sum(axis=0) + alone) / (here.sum(axis=0) + 1)
        model = LabelModel(float(np.clip(post.mean(), 1e-3, 1 - 1e-3)), parent, np.clip(rates, 1e-4, 1 - 1e-4))
        post = model.posterior(vote)
    return model, post


def design(features: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: log-counts, distinct terms and their density, patterns, and one."""
    counts = features[:, :-PATTERNS].astype(np.float64)
    words = np.expm1(features[:, -1:].astype(np.float64) * 10)
    distinct, total = (counts > 0).sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(counts), np.log1p(distinct), np.log1p(100 * total / np.maximum(words, 1)), features[:, -PATTERNS:], np.ones((len(features), 1))])


def regression(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _packed(features: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Where each row's values other than 0 are, and the values."""
    row, at = np.nonzero(features)
    ends = np.searchsorted(row, np.arange(len(features) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(features[row, at]))


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray | None

    def predict(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """docs and a column of scores."""
        names, terms, weights = docs.columns, self.terms, self.weights
        inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
        at = names.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(terms)
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                out = np.zeros(len(batch))
                for a, b in row_blocks(offsets, BLOCK) if weights is not None else ():
                    out[a:b] = 1 / (1 + np.exp(-np.clip(design(counter.features(data, offsets[a : b + 1])) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "x_score"])

        return inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("x_score", T.DoubleType())])).toDF(*names, own_name(names, score))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from the rows of docs that labels (doc_id, toxic) covers."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(toxic).alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(in_share(F.col("doc_id"), share)) if share < 1 else known
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # about `sample` ids
    rows = written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic"), "labelled")
    total, bad = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("toxic")).first())
    if not 0 < bad < total:
        return Model(np.zeros(0, np.uint64), None)
    terms = lexicon(rows, bad, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(terms)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in row_blocks(offsets, BLOCK):
                found = counter.features(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), *_packed(found)], ["toxic", "at", "value"])

    table = rows.mapInArrow(run, "toxic int, at array<int>, value array<float>").toArrow()  # about `sample` rows, TERMS + PATTERNS values at most
    gold = table.column("toxic").to_numpy()
    features = np.zeros((len(gold), len(terms) + PATTERNS), np.float32)
    at, value = table.column("at").combine_chunks(), table.column("value").combine_chunks()
    features[np.repeat(np.arange(len(gold)), pa.compute.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = value.flatten().to_numpy()
    _, post = label_model(votes(features, gold))
    return Model(terms, regression(design(features), post))
