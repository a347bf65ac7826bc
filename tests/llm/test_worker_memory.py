"""What a Python worker holds beside its rows: pieces, batches of words and batches of rows are small, and give the same."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from cartolith.llm import common, langid, textblocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def peak(work):
    """MB that work() takes at most, of its own and in what it leaves, and its result."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_hashing_takes_a_few_times_its_piece(monkeypatch):
    monkeypatch.setattr(textblocks, "_cache", {})
    data, offsets = textblocks.column_bytes(pa.array(["some words of the text " * 100000] * 2, pa.string()))
    most, (hashes, counts) = peak(lambda: textblocks.hash_words(data, offsets, textblocks.ALNUM))
    assert counts.tolist() == [500000, 500000] and len(np.unique(hashes)) == 5
    assert most < 50  # 8 of them are the hashes


def words(n):
    rng = np.random.default_rng(3)
    column = pa.array(["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(7, 9, n)], pa.binary())
    return textblocks.column_bytes(column)


def test_words_are_scored_and_counted_in_small_batches(monkeypatch):
    data, offsets = words(60000)
    vocabulary = langid.pieces(RANKS)
    prob = np.full((5, len(vocabulary)), 1 / len(vocabulary))

    def score():
        out = np.zeros((len(offsets) - 1, 5))
        for part, matrix, sizes in langid._batches(data, offsets[:-1], np.diff(offsets), 5):
            out[part] = langid.forward(matrix, vocabulary, prob, sizes)
        return out

    def count():
        out = np.zeros(prob.shape)
        for part, matrix, sizes in langid._batches(data, offsets[:-1], np.diff(offsets), 8):
            out += langid.expected(matrix, vocabulary, prob, part % 5, np.ones(len(part)), sizes)
        return out

    small = [peak(score), peak(count)]
    assert small[0][0] < 22 and small[1][0] < 25
    monkeypatch.setattr(langid, "CELLS", 1 << 22)
    for (_, got), want in zip(small, (score(), count()), strict=True):
        assert got == pytest.approx(want)


def test_stages_bound_the_bytes_of_a_batch(spark, sf_dir):
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    docs = spark.createDataFrame([(1, "a b c", "en", "x")], "doc_id bigint, text string, lang string, source string")
    try:
        for _, stage in corpus_pipeline.STAGES:
            for setting, held in (("64m", f"{4 << 20}b"), ("1m", "1m")):
                spark.conf.set(BYTES, setting)
                stage(spark, docs, sf_dir)
                assert spark.conf.get(BYTES) == held
        assert [common._bytes(x) for x in ("67108864b", "64m", "64MB", "65536k", "7", "-1")] == [64 << 20] * 2 + [64 << 20] * 2 + [7, -1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
