"""Texts, words and benchmarks of many megabytes: time and memory keep in proportion to them."""

import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from cartolith.llm import bpe, decontam, langid

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def stitched(text, size=32768, overlap=1024):
    starts = list(range(0, max(1, len(text) - overlap), size - overlap))
    chunks = [text[k : k + size] for k in starts]
    return bpe.stitch(chunks, starts, [bpe.boundaries(c, PATTERN) for c in chunks], PATTERN)


def test_a_text_without_boundaries_takes_time_in_proportion():
    text = "a" * (16 << 20)
    began = time.time()
    assert "".join(stitched(text)) == text
    assert time.time() - began < 10


@pytest.mark.parametrize("text", ["a" * 300000, "a" * 100000 + " b c" * 50000, (" " * 70000 + "x") * 4, "one two " * 9000 + "z" * 200000 + "!! 12\n" * 9000])
def test_long_runs_have_the_plain_ids(text):
    enc = bpe.encoding(RANKS, PATTERN)
    ranges = stitched(text)
    assert "".join(ranges) == text
    assert b"".join(bpe.encode_text(enc, r) for r in ranges) == bpe.encode_text(enc, text)


def plain_windows(texts, window=13):
    out = {}
    for i, t in enumerate(texts):
        words = t.split()
        size = min(window, len(words))
        for a in range(len(words) - size + 1 if size else 0):
            out.setdefault(tuple(words[a : a + size]), set()).add(i)
    return out


def test_windows_are_those_of_a_plain_walk(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 2, rng.integers(0, 40))) for _ in range(60)]
    texts += [texts[3], "w0", "w0 w1", "", "..."]
    monkeypatch.setattr(decontam, "SHARD", 50)
    windows = decontam.Windows([(str(i), t) for i, t in enumerate(texts)])
    flat = [w for t in texts if t != "..." for w in t.split()]
    got = {tuple(flat[s : s + n]): set(windows.owners(k).tolist()) for k, (s, n) in enumerate(zip(windows.starts, windows.lengths, strict=True))}
    assert got == plain_windows([t.replace(".", "") for t in texts]) and len(got) == len(windows.starts)


def test_unlike_windows_of_one_key_stay_apart():
    windows = decontam.Windows([("a", "x y"), ("b", "y x")])
    stream, start, length = windows.stream, np.array([0, 2]), np.array([2, 2], np.int32)
    assert windows._equal(start, length, np.array([0]), np.array([0])) and not windows._equal(start, length, np.array([0]), np.array([1]))
    assert len(stream) == 4 and len(windows.starts) == 2


def test_a_block_of_items_stays_small():
    rng = np.random.default_rng(0)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 200000, 200))) for i in range(3000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontam.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows.starts) == 3000 * 188
    assert peak < 40 * size  # 16 MB of items: 640 MB at most


def test_a_very_long_word_stays_small():
    vocabulary = langid.pieces(RANKS)
    word = np.frombuffer("".join(map(chr, np.random.default_rng(0).integers(0x4E00, 0x9FFF, 40000))).encode(), np.uint8)
    prob = np.full((3, len(vocabulary)), 1 / len(vocabulary))
    tracemalloc.start()
    counts = langid.expected(word[None], vocabulary, prob, np.array([1]), np.array([2.0]))
    logs = langid.forward(word[None], vocabulary, prob)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sizes = np.array([len(w) for w in vocabulary.words])
    assert counts[0].sum() == counts[2].sum() == 0 and np.isclose((counts[1] * sizes).sum(), 2 * len(word))
    assert np.isfinite(logs).all() and np.allclose(logs, logs[0, 0])
    assert peak < 200 * len(word)  # a million such characters: 600 MB at most
