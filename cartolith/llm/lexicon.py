"""Byte-level BPE with a lexicon of frequent words: a minimal acyclic transducer whose outputs are ids.

Words (matches of the pre-tokeniser's pattern) of all texts are counted, and the WORDS most frequent of at most
WORD_BYTES bytes are compiled into a transducer over bytes: states with equal futures are one, so that words share their
ends as well as their beginnings, and a word's ids are pushed to the first transitions that tell it from others. It lies in a
file of flat arrays that Spark hands to each executor, where tasks map it into memory and look distinct words up all at
once, a byte of each a step. Words that it doesn't hold are merged exactly, by the merge table, with a heap of pairs. What
the lexicon holds changes the speed, never the ids.

A special token's text in a document becomes its id, as the library does by default; the text between is split on its
own. Decoding concatenates the bytes of ids and reads them as UTF-8, with U+FFFD for bytes that are none.

Null texts are empty, and an empty text has no ids. Rows that repeat stay; an empty table gives an empty one. Other columns
are kept where asked for; encode()'s columns get a leading underscore where docs has one of their names. A text is whole in
one task. Short texts, TAKEN bytes together, are cut into words by conditions on neighbouring characters, and only their distinct
words are looked up; longer ones are walked through, and taken up in parts of PART words.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import new_folder, own_name, small_batches
from cartolith.llm.tokencount import opened

#: Words of a lexicon at most, their bytes, and how often they must occur.
WORDS, WORD_BYTES, LEAST = 1 << 17, 64, 2
#: Words that a task takes up at once, distinct ones that it counts at once, and bytes of short texts that it cuts at once.
PART, HELD, TAKEN = 1 << 18, 1 << 18, 1 << 21
#: Arrays of a lexicon's file, in order: transitions of state s are edges starts[s] to starts[s + 1], by byte.
ARRAYS = ("starts", "byte", "target", "out_starts", "out", "final", "final_starts", "final_out")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def ranges(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of flat that have these beginnings and sizes, one behind the other."""
    return flat[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]


def lists(counts: np.ndarray, flat: np.ndarray) -> list[list[int]]:
    """flat in lists of these sizes."""
    ids, ends = flat.tolist(), np.cumsum(counts).tolist()
    return [ids[end - n : end] for end, n in zip(ends, counts.tolist(), strict=True)]


@dataclass
class Tokenizer:
    """What a tokenizer's JSON file says: ids of bytes, merges of pairs of ids (rank and result), bytes of ids, special tokens."""

    first: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    bytes_of: dict[int, bytes]
    special: dict[str, int]

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def read(path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as file:
            all_ = json.load(file)
        model, letters = all_["model"], byte_letters()
        split = all_["pre_tokenizer"]
        plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and all_["normalizer"] is None
        if not plain or any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t[k] for t in all_["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take their surroundings aren't supported")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in all_["added_tokens"]}
        raw = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if i not in special.values()}
        raw |= {i: t.encode() for t, i in special.items()}
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        of_byte = {b: vocab[c] for c, b in letters.items()}
        return Tokenizer([of_byte[b] for b in range(256)], merges, raw, special)

    @functools.cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of pairs with their ranks, the result of each rank, and the ids of bytes."""
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        results = np.empty(len(ranks), np.int64)
        results[ranks] = [new for _, new in self.merges.values()]
        order = np.argsort(keys)
        return keys[order], ranks[order], results, np.array(self.first, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, ranks, _, _ = self._tables
        key = a << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], len(ranks))

    def merged_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short words: how many ids each has, and all ids in order.

        In each round the least pair of each word merges, all words at once.
        """
        _, _, results, first = self._tables
        none = len(results)
        rows, sizes, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]  # of words that are done
        row = np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = first[np.frombuffer(b"".join(words), np.uint8)]
        row, size = row[size > 0], size[size > 0]
        last = np.cumsum(size) - 1
        rank = np.full(len(ids), none)  # of each place's id with the next one of its word
        if len(ids) > 1 and none:
            rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[last] = none
        while len(row):
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begin)
            done = least == none
            if done.any():
                places = np.repeat(done, size)
                rows.append(row[done])
                sizes.append(size[done])
                found.append(ids[places])
                ids, rank, row, size, least = ids[~places], rank[~places], row[~done], size[~done], least[~done]
                if not len(row):
                    break
                begin = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(least, size))
            word = np.searchsorted(begin, hits, side="right") - 1
            at = hits[np.concatenate([[True], word[1:] != word[:-1]])]  # the leftmost of each word
            ids[at] = results[least]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            size = size - 1
            at = at - np.arange(len(at))
            ids, rank = ids[stays], rank[stays]
            rank[at] = none
            end = np.cumsum(size) - 1
            inner = at < end
            rank[at[inner]] = self._ranks(ids[at[inner]], ids[at[inner] + 1])
            behind = at > end - size + 1
            rank[at[behind] - 1] = self._ranks(ids[at[behind] - 1], ids[at[behind]])
        done, n = np.concatenate(rows), np.concatenate(sizes)
        order, begins = np.argsort(done), np.cumsum(n) - n
        counts = np.zeros(len(words), np.int64)
        counts[done] = n
        return counts, ranges(np.concatenate(found).astype(np.int32), begins[order], n[order])

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: always the pair of least rank merges, the leftmost of equals."""
        ids = [self.first[b] for b in word]
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        get, heap = self.merges.get, []
        for i in range(end - 1):
            if found := get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if found := get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, ids[k]))
            if (h := before[i]) >= 0 and (found := get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], ids[h], new))
        return [i for i in ids if i >= 0]


#: The split of a byte-level pre-tokeniser: letters, English endings, digits, others, white space. ASCII texts have a faster form.
ANY = regex.compile(r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII = re.compile(r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


#: Classes of characters: letters, digits and others come before.
OTHER_WHITE, SPACE, UNKNOWN = 3, 4, 255


def _pattern(text: str) -> re.Pattern | regex.Pattern:
    return ASCII if text.isascii() else ANY


class Splitter:
    """Words of a text as the library splits it, whose Unicode tables may be of another age than this one's.

    Characters outside ASCII that the library puts into another class are replaced by one of that class for the split.
    """

    def __init__(self, special: dict[str, int]) -> None:
        from tokenizers import pre_tokenizers

        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.tokens = list(special)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: set[str] = set(map(chr, range(128)))
        self.stand_ins: dict[int, str] = {}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[ord(" ")] = SPACE

    @staticmethod
    def _alike(char: str, split) -> list[int]:
        """How a split takes a character among others: equal for characters of a class."""
        return [len(x) for x in split(f"a{char}a1{char}1-{char}-{char}")]

    def _library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _learn(self, char: str) -> None:
        want = self._alike(char, self._library)
        if want != self._alike(char, ANY.findall):
            self.stand_ins[ord(char)] = next(c for c in "a1-\t" if self._alike(c, ANY.findall) == want)
        self.known.add(char)

    def _classes(self, chars: np.ndarray) -> np.ndarray:
        """The class of each character, by the library."""
        found = self.classes[chars]
        if (found == UNKNOWN).any():
            for c in np.unique(chars[found == UNKNOWN]).tolist():
                want = self._alike(chr(c), self._library)
                self.classes[c] = next(k for k, other in enumerate("a1-\t") if self._alike(other, self._library) == want)
            found = self.classes[chars]
        return found

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts cut() takes: short ones without special tokens."""
        good = pc.less_equal(pc.utf8_length(texts), PART).to_numpy(zero_copy_only=False)
        for token in self.tokens:
            good &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return good

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of these plain texts in order, and how many each text has. The pattern of ANY as conditions on neighbours."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = b"".join(v.as_buffer() for v in texts)
        if not data:
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        places = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # the first byte of each character
        begins = np.searchsorted(places, (np.cumsum(sizes) - sizes)[sizes > 0])  # the first character of each text
        of = self._classes(chars)
        white = of >= OTHER_WHITE
        start = np.ones(len(chars), bool)
        start[1:] = of[1:] != of[:-1]
        start[1:] &= (of[:-1] != SPACE) | white[1:]  # a space goes with what follows
        start[1:] &= ~(white[1:] & white[:-1])
        start[begins] = True
        # the last of a run of white space, if anything else follows in this text, is by itself
        last = white.copy()
        last[-1] = False
        last[:-1] &= ~white[1:]
        last[begins[1:] - 1] = False
        start |= last
        quotes = np.flatnonzero((chars == ord("'")) & start)
        ends = np.append(begins[1:], len(chars))[np.searchsorted(begins, quotes, side="right") - 1]
        one, two = (np.where(quotes + k < ends, chars[np.minimum(quotes + k, len(chars) - 1)], 0) for k in (1, 2))
        n = np.where(np.isin(one, list(map(ord, "stmd"))), 2, 0)
        for ending in ("re", "ve", "ll"):
            n[(one == ord(ending[0])) & (two == ord(ending[1]))] = 3
        quotes, ends, n = quotes[n > 0], ends[n > 0], n[n > 0]
        start[quotes + 1] = False
        after = quotes + n
        start[after[after < ends]] = True
        at = np.flatnonzero(start)
        offsets = np.append(places[at], len(data)).astype(np.int32)
        counts = np.zeros(len(texts), np.int64)
        counts[sizes > 0] = np.diff(np.append(np.searchsorted(at, begins), len(at)))
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether each is a special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _seen(self, section: str) -> str:
        """The section as the pattern is to see it, as long as it was."""
        if section.isascii():
            return section
        for char in set(section).difference(self.known):
            self._learn(char)
        return section.translate(self.stand_ins) if self.stand_ins else section

    def split(self, section: str) -> list[str]:
        """All words of a section; its size should have a bound."""
        seen = self._seen(section)
        words = _pattern(seen).findall(seen)
        if seen is section or seen == section:
            return words
        ends = list(accumulate(map(len, words)))
        return [section[end - len(w) : end] for w, end in zip(words, ends, strict=True)]

    def walk(self, section: str) -> Iterator[str]:
        """The words of a section one by one."""
        seen = self._seen(section)
        return (section[m.start() : m.end()] for m in _pattern(seen).finditer(seen))

    def bundles(self, texts: Iterable[str]) -> Iterator[list[tuple[int, str, bool]]]:
        """The sections of texts, with the number of their text and whether they are a special token: some PART characters at once.

        A section that is longer comes alone.
        """
        group, size = [], 0
        for i, text in enumerate(texts):
            for section, special in self.sections(text):
                if group and size + len(section) > PART:
                    yield group
                    group, size = [], 0
                group.append((i, section, special))
                size += len(section)
        if group:
            yield group

    def parts(self, section: str) -> Iterator[pa.Array]:
        """The words of a long section, PART at once."""
        words = self.walk(section)
        while part := list(islice(words, PART)):
            yield pa.array([w.encode() for w in part], pa.binary())


@functools.lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(Tokenizer.read(path).special)


class _State:
    """A state that is being built: edges by byte, each with a target and ids; ids that a word which ends here still has."""

    __slots__ = ("edges", "end", "number")

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}
        self.end: tuple[int, ...] | None = None
        self.number = -1

    def key(self) -> tuple:
        return self.end, tuple((b, t.number, ids) for b, (t, ids) in self.edges.items())


def _common(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def compiled(entries: list[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The arrays of the minimal transducer of sorted, distinct words and their ids.

    The words' states that the next word leaves are settled from the last one back: one that equals a settled state is
    replaced by it. State 0 is where no word goes on, state 1 is the first of all.
    """
    root, settled, done = _State(), {}, []
    path = [root]

    def settle(to: int, word: bytes) -> None:
        for i in range(len(path) - 1, to, -1):
            state = path.pop()
            key = state.key()
            if key in settled:
                path[-1].edges[word[i - 1]][0] = settled[key]
            else:
                state.number, settled[key] = len(done) + 2, state
                done.append(state)

    last = b""
    for word, ids in entries:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        settle(shared, last)
        left = ids
        for i in range(shared):  # ids that this word doesn't share move behind the transition
            edge = path[i].edges[word[i]]
            n = _common(edge[1], left)
            moved, edge[1] = edge[1][n:], edge[1][:n]
            if moved:
                below = edge[0]
                for e in below.edges.values():
                    e[1] = moved + e[1]
                if below.end is not None:
                    below.end = moved + below.end
            left = left[n:]
        for i in range(shared, len(word)):
            state = _State()
            path[-1].edges[word[i]] = [state, left]
            left = ()
            path.append(state)
        path[-1].end = left
        last = word
    settle(0, last)
    root.number = 1
    none = _State()
    none.number = 0
    every = [none, root, *done]
    edges = [(b, t.number, ids) for s in every for b, (t, ids) in s.edges.items()]
    ends = [s.end or () for s in every]

    def starts(sizes: list[int]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)

    return {
        "starts": starts([len(s.edges) for s in every]),
        "byte": np.array([e[0] for e in edges], np.uint8),
        "target": np.array([e[1] for e in edges], np.int32),
        "out_starts": starts([len(e[2]) for e in edges]),
        "out": np.array([i for e in edges for i in e[2]], np.int32),
        "final": np.array([s.end is not None for s in every], np.uint8),
        "final_starts": starts([len(e) for e in ends]),
        "final_out": np.array([i for e in ends for i in e], np.int32),
    }


class Transducer:
    """The arrays of a lexicon, and look-ups of many words at once."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        for name in ARRAYS:
            setattr(self, name, arrays[name])
        states = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int64), np.diff(self.starts))
        self.keys = states << 8 | self.byte  # edges lie in order of state and byte
        self.outs = np.concatenate([self.out, self.final_out])

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        sizes = np.fromfile(path, "<i8", len(ARRAYS))
        arrays, at = {}, 8 * len(ARRAYS)
        for name, n in zip(ARRAYS, sizes.tolist(), strict=True):
            kind = np.dtype(np.uint8 if name in ("byte", "final") else "<i4")
            arrays[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind)
            at += n * kind.itemsize
        return cls(arrays)

    def file(self) -> bytes:
        sizes = np.array([len(self.arrays[n]) for n in ARRAYS], "<i8")
        return sizes.tobytes() + b"".join(self.arrays[n].tobytes() for n in ARRAYS)

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for those that the lexicon doesn't hold."""
        held, counts, flat = self.look_up_all(words)
        return [ids if h else None for h, ids in zip(held.tolist(), lists(counts, flat), strict=True)]

    def look_up_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the lexicon holds each word, how many ids the word has (0, if not held), and all ids in order."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        is_good = np.zeros(len(words), bool)
        rows = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES))
        if not len(rows) or not len(self.keys):
            return is_good, np.zeros(len(words), np.int64), np.empty(0, np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.ones(len(rows), np.int64)
        places, edges = [], []  # words and transitions with ids, step by step
        for step in range(int(lengths[rows].max())):
            goes = np.flatnonzero(lengths[rows] > step)
            live = rows[goes]
            key = state[goes] << 8 | data[begins[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            state[goes] = np.where(hit, self.target[edge], 0)
            has = hit & (self.out_starts[edge + 1] > self.out_starts[edge])
            places.append(live[has])
            edges.append(edge[has])
            stay = state > 0
            rows, state = rows[stay], state[stay]
        good = self.final[state] > 0
        rows, state = rows[good], state[good]
        place, edge = np.concatenate(places), np.concatenate(edges)
        begin = np.concatenate([self.out_starts[edge], self.final_starts[state] + len(self.out)]).astype(np.int64)
        end = np.concatenate([self.out_starts[edge + 1], self.final_starts[state + 1] + len(self.out)]).astype(np.int64)
        place = np.concatenate([place, rows])
        is_good[rows] = True
        order = np.argsort(place, kind="stable")
        order = order[is_good[place[order]]]
        begin, n = begin[order], (end - begin)[order]
        return is_good, np.bincount(place[order], n, len(words)).astype(np.int64), ranges(self.outs, begin, n)


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order (null: empty), TAKEN bytes or one text at once."""
    texts = texts.fill_null("")
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and size + n > TAKEN:
            yield texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield texts[begin:]


def word_parts(texts: pa.Array, own: Splitter) -> Iterator[pa.Array]:
    """The words of a portion of texts, in any order, without special tokens."""
    plain = own.plain(texts)
    yield own.cut(texts.filter(pa.array(plain)))[0]
    for group in own.bundles(t.as_py() for t in texts.filter(pa.array(~plain))):
        sections = [s for _, s, special in group if not special]
        if any(len(s) > PART for s in sections):
            yield from own.parts(*sections)
        else:
            yield own.cut(pa.array(sections, pa.string()))[0]


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n) of all words of at most WORD_BYTES bytes, of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = splitter(path), {}

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return found

        get = held.get
        for texts in chain.from_iterable(portions(batch.column(0)) for batch in batches):
            for words in word_parts(texts, own):
                found = pc.value_counts(words)
                found = found.filter(pc.less_equal(pc.binary_length(found.field(0)), WORD_BYTES))
                for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                    held[w] = get(w, 0) + n
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, path: str, text: str = "text", words: int = WORDS, least: int = LEAST) -> str:
    """Compiles the most frequent words of docs (ties: the least bytes) and adds the file to the session's; returns its name.

    The words come to the driver, words * WORD_BYTES bytes at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frequent = word_counts(docs, path, text).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).select("word")
    own = Tokenizer.read(path)
    found = sorted(frequent.toArrow().column(0).to_pylist())
    entries = [(w, tuple(ids)) for w, ids in zip(found, lists(*own.merged_all(found)), strict=True)]
    return shared(spark, Transducer(compiled(entries)))


def shared(spark: SparkSession, lexicon: Transducer) -> str:
    """Writes a lexicon to the shared folder, from where Spark copies it to each executor once; the name of that copy."""
    folder = new_folder(spark, "lexicon")
    name = f"{folder.rpartition('/')[2]}.bin"
    system, base = opened(folder)
    system.create_dir(base)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(lexicon.file())
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


@functools.lru_cache(maxsize=2)
def _mapped(name: str) -> Transducer:
    return Transducer.mapped(SparkFiles.get(name))


class Values:
    """A value of each id, as bytes."""

    def __init__(self, values: dict[int, bytes]) -> None:
        self.all = pa.array([values.get(i, b"") for i in range(max(values) + 1)], pa.large_binary())

    def of(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """The values of the first counts[0] ids put together, those of the next counts[1] and so on."""
        if not len(ids):
            return repeat(memoryview(b""), len(counts))
        _, offsets, data = self.all.take(pa.array(ids)).buffers()
        data = memoryview(data)
        ends = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return (data[a:b] for a, b in pairwise(ends))


class Encoder:
    """A task's texts to ids; it keeps the ids of words that it met and that the lexicon holds."""

    def __init__(self, path: str, lexicon: Transducer) -> None:
        self.tokenizer, self.lexicon = Tokenizer.read(path), lexicon
        self.splitter = splitter(path)
        raw = self.tokenizer.bytes_of
        self.names, self.raw = Values({i: b"%d," % i for i in raw}), Values(raw)
        self.special = {s: np.array([i], np.int32) for s, i in self.tokenizer.special.items()}
        self.kept: dict[bytes, int] = {}
        self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int32)  # of what is kept, one behind the other

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order. What the lexicon holds is kept, as its number has a bound."""
        coded = pc.dictionary_encode(words)
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        slot = np.fromiter(map(self.kept.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        raw = [distinct[i] for i in new.tolist()]
        held, counts, ids = self.lexicon.look_up_all(raw)
        slot[new[held]] = np.arange(held.sum()) + len(self.kept)
        self.kept.update(zip([raw[i] for i in np.flatnonzero(held).tolist()], slot[new[held]].tolist(), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, counts[held]])
        raw = [raw[i] for i in np.flatnonzero(~held).tolist()]
        new = new[~held]
        long = np.fromiter(map(len, raw), np.int64, len(raw)) > WORD_BYTES
        counts, ids = self.tokenizer.merged_all([raw[i] for i in np.flatnonzero(~long).tolist()])
        ones = [np.array(self.tokenizer.merged(raw[i]), np.int32) for i in np.flatnonzero(long).tolist()]
        slot[np.concatenate([new[~long], new[long]])] = np.arange(len(new)) + len(self.kept)
        sizes = np.concatenate([self.sizes, counts, np.array(list(map(len, ones)), np.int64)])
        begins = (np.cumsum(sizes) - sizes)[slot]
        sizes = sizes[slot][number]
        return sizes, ranges(np.concatenate([self.ids, ids, *ones]), begins[number], sizes)

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of these plain texts."""
        words, counts = self.splitter.cut(texts)
        sizes, ids = self._coded(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [ids[a:b] for a, b in pairwise(ends)]

    def _others(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of these texts, of any kind."""
        found: list[list[np.ndarray]] = [[np.empty(0, np.int32)] for _ in texts]
        for group in self.splitter.bundles(texts):
            if len(group[0][1]) > PART and not group[0][2]:
                for words in self.splitter.parts(group[0][1]):
                    found[group[0][0]].append(self._coded(words)[1])
                continue
            short = iter(self._cut(pa.array([s for _, s, special in group if not special], pa.string())))
            for i, section, special in group:
                found[i].append(self.special[section] if special else next(short))
        return list(map(np.concatenate, found))

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text of a portion has, and all ids in order."""
        plain = self.splitter.plain(texts)
        short = iter(self._cut(texts.filter(pa.array(plain))))
        others = iter(self._others(texts.filter(pa.array(~plain)).to_pylist()))
        found = [next(short if good else others) for good in plain.tolist()]
        return np.array(list(map(len, found)), np.int64), np.concatenate(found)

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """For each text the number of its ids, the ids in decimal, and their bytes put together from the ids."""
        for portion in portions(texts):
            counts, ids = self.coded(portion)
            names = (v[:-1] for v in self.names.of(ids, counts))
            yield from zip(counts.tolist(), names, self.raw.of(ids, counts), strict=True)

    def entries(self, texts: Iterable[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """texts() of one text after the other, as values in a list, which is empty for a text without ids."""
        for text in texts:
            yield [(n, str(names, "ascii"), bytes(raw)) for n, names, raw in self.texts(pa.array([text], pa.string())) if n]


def _column_of(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns.index(text)


def encode(docs: DataFrame, path: str, lexicon: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs and a column of each text's ids."""
    inner, at = _column_of(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, _mapped(lexicon))
        for batch in batches:
            at_row = 0
            for texts in portions(batch.column(at)):
                counts, found = encoder.coded(texts)
                for mine in np.split(found, np.cumsum(counts)[:-1]):
                    yield pa.RecordBatch.from_arrays([*batch.slice(at_row, 1).columns, pa.array([mine], pa.list_(pa.int32()))], [*batch.schema.names, "x_ids"])
                    at_row += 1

    made = T.StructField("x_ids", T.ArrayType(T.IntegerType()))
    return inner.mapInArrow(run, T.StructType([*inner.schema.fields, made])).toDF(*docs.columns, own_name(docs.columns, ids))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs and a column of the text that each row's ids stand for; null ids give an empty one, ids that aren't known an error."""
    inner, at = _column_of(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Tokenizer.read(path).bytes_of
        for batch in batches:
            texts = [b"".join([raw[i] for i in x.as_py() or ()]).decode("utf-8", "replace") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "x_text"])

    made = T.StructField("x_text", T.StringType())
    return inner.mapInArrow(run, T.StructType([*inner.schema.fields, made])).toDF(*docs.columns, own_name(docs.columns, decoded))


def digests(docs: DataFrame, path: str, lexicon: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all but the text, if none are named), n_tokens, ids_sha256 and decoded_sha256 of each text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("x_text"))
    fields = inner.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, _mapped(lexicon))
        for batch in batches:
            sizes, names, texts = [], [], []
            for n, ids, raw in encoder.texts(batch.column(len(keep))):
                sizes.append(n)
                names.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(str(raw, "utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())], [*batch.schema.names[:-1], *made])

    made = ["x_n", "x_ids", "x_decoded"]
    schema = T.StructType([*fields, *(T.StructField(m, k) for m, k in zip(made, (T.LongType(), T.StringType(), T.StringType()), strict=True))])
    return inner.mapInArrow(run, schema).toDF(*keep, "n_tokens", "ids_sha256", "decoded_sha256")


def report(docs: DataFrame, path: str) -> DataFrame:
    texts = docs.select("doc_id", "text")
    return digests(texts, path, build(texts, path))
