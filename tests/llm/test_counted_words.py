"""Centroid clustering, collocations and the lexicon encoder: contracts on whole tables, parts against plain forms, odd rows."""

import glob
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cartolith.llm import collocations, lexicon, lloyd, queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(LIBRARY)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_collocations"])
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    got, want = QUERIES[name](spark, sf_dir), tables.sql(SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# -- clustering


def plain_lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) if abs(x) < 1e15 else int(x) * 64 for x in v]) for i, v in rows]
    order = sorted(range(len(kept)), key=lambda j: hashlib.sha256(f"1:{kept[j][0]}".encode()).hexdigest())
    centroids = [kept[j][1] for j in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if mine[j] else c for j, c in enumerate(centroids)]
    return {i: nearest(v) for i, v in kept}, centroids


def vectors(spark, rows):
    return spark.createDataFrame(rows, "cluster string, vec_id bigint, embedding array<double>, n int")


def test_lloyd_against_plain_form(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * 3 - 1).tolist()) for i in range(300)]
    df, centroids = lloyd.cluster(vectors(spark, [("x", i, v, 1) for i, v in rows]), k=7, rounds=3)
    want, plain = plain_lloyd(rows, 7, 3)
    assert centroids == plain
    got = df.collect()
    assert {r.vec_id: (r.distance, r.cluster) for r in got} == want
    assert {r.inertia for r in got} == {sum(d for d, _ in want.values())}
    for r in got:
        assert r.cluster_inertia == sum(d for d, j in want.values() if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest()


def test_lloyd_large_components_are_exact(spark):
    rows = [(i, [float(s)] + [0.0] * 63) for i, s in enumerate((3e12, -3e12, 1.5, -1.5, 3e12, 2.0**70))]
    df, centroids = lloyd.cluster(vectors(spark, [("x", i, v, 1) for i, v in rows]), k=3, rounds=2)
    want, plain = plain_lloyd(rows, 3, 2)
    assert centroids == plain
    assert {r.vec_id: (r.distance, r.cluster) for r in df.collect()} == {i: (min(d, lloyd.LONGEST), j) for i, (d, j) in want.items()}


def test_lloyd_odd_rows(spark):
    good, other = [0.5] * 64, [0.25] * 64
    odd = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")]]
    rows = [("x", 10 + i, v, 1) for i, v in enumerate(odd)]
    got = lloyd.report(vectors(spark, [*rows, ("x", 1, good, 1), ("x", 1, good, 1), ("x", None, other, 2), ("x", (1 << 62) + 1, other, 1)])).collect()
    assert sorted((str(r.vec_id), r.distance) for r in got) == [("1", 0), ("1", 0), (str((1 << 62) + 1), 0), ("None", 0)]
    assert len({r.cluster for r in got}) == 2  # equal centroids: the lowest number
    assert lloyd.report(vectors(spark, rows)).count() == 0
    assert lloyd.report(vectors(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_digits_of_sums():
    for v in ([0, 5, -1], [1 << 40, -(1 << 40), 7], [(1 << 90) + 3, -(1 << 91) - 9, 0]):
        got = lloyd.digits(v)
        assert [sum(d[i] << (lloyd.DIGIT * k) for k, d in enumerate(got)) for i in range(3)] == v
        assert all(abs(x) <= 1 << 40 for d in got for x in d)


# -- collocations


def plain_counts(docs, longest=5):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    return f, n


def test_automaton_has_each_phrase_once():
    rng = random.Random(2)
    for _ in range(60):
        words = np.array([0] + [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 80))])
        automaton = collocations.Automaton.build(words, 4)
        want, got = Counter(), Counter()
        for k in range(1, 5):
            for i in range(len(words) - k + 1):
                if words[i : i + k].all():
                    want[tuple(words[i : i + k])] += 1
        for columns, counts in automaton.phrases(1):
            for phrase, n in zip(columns.tolist(), counts.tolist(), strict=True):
                assert tuple(phrase) not in got
                got[tuple(phrase)] = n
        assert got == want
        assert (automaton.link_length < automaton.length).all() and (automaton.length <= 4).all()
        # a state's phrases are ends of each other with the same places: as few states as there are such classes
        ends = defaultdict(set)
        for k in range(1, 5):
            for i in range(len(words) - k + 1):
                if words[i : i + k].all():
                    ends[tuple(words[i : i + k])].add(i + k)
        assert len(automaton.count) == len(set(map(frozenset, ends.values())))


def test_counts_with_a_filter_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(rng.choice(["a", None, "b"]), " ".join(rng.choice(["x", "Y", "zed", "\t", "w,", "é"]) for _ in range(300)) + rng.choice(["", " x x x"])) for _ in range(30)]
    monkeypatch.setattr(collocations, "SHARD", 700)
    phrases, totals = collocations.frequent_phrases(spark.createDataFrame(docs, "lang string, text string"), least=20)
    f, n = plain_counts(docs)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.collect()} == {k: c for k, c in f.items() if c >= 20}
    assert dict(map(tuple, totals.collect())) == n


def test_collocations_odd_rows(spark):
    text = "new york city hall. New York, new\tyork"
    docs = [("en", text, "z")] * 60 + [(None, "\x1fab cd ef cd ef", "z")] * 100 + [("en", None, "z"), ("en", "", "z"), ("en", " \n.,", "z"), (None, "x" * 100000, "z")]
    df = spark.createDataFrame(docs, "lang string, text string, phrase string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = sorted(con.sql(collocations.ORACLE).fetchall())
    got = sorted(map(tuple, collocations.report(df).collect()))
    assert got == want and any(r[2] == "new york" for r in got)
    assert collocations.report(df.where("false")).collect() == []


def test_ranks_beyond_the_last_are_left_out(spark):
    rows = spark.createDataFrame([("a", f"p {i}", i % 7, 1, 1, 1, i % 5) for i in range(500)], "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [(r.rank, r.phrase) for r in collocations.ranked(rows, 20).orderBy("rank").collect()]
    want = sorted(((-(i % 5), -(i % 7), f"p {i}") for i in range(500)))[:20]
    assert got == [(k + 1, p) for k, (_, _, p) in enumerate(want)]


# -- lexicon


def test_op13(spark, sf_dir, tables, library):
    got = {r.doc_id: r for r in QUERIES["op13_lexicon_bpe"](spark, sf_dir).collect()}
    docs = tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def encoder(words=()):
    own = lexicon.Tokenizer.read(LIBRARY)
    return lexicon.Encoder(LIBRARY, lexicon.Transducer(lexicon.compiled([(w, tuple(own.merged(w))) for w in sorted(words)])))


def ids_of(enc, text):
    (found,) = enc.entries([text])
    return [int(i) for e in found for i in e[1].split(",")]


def test_splits_as_the_library_does():
    own = lexicon.splitter(LIBRARY)
    for a in range(128):
        for b in range(128):
            text = f"{chr(a)}{chr(b)}{chr(a)}x {chr(b)}"
            assert own.split(text) == [text[i:j] for _, (i, j) in own.library.pre_tokenize_str(text)]
    for c in [*range(0x80, 0x3000, 7), 0x558, 0x88F, 0x208F, 0x2CEB0, 0x3FC3F, 0x1F600, 0xE0001]:
        text = f"a{chr(c)}1{chr(c)} {chr(c)}'s-{chr(c)}{chr(c)}  {chr(c)}b ՘"
        want = [text[i:j] for _, (i, j) in own.library.pre_tokenize_str(text)]
        assert own.split(text) == want and list(own.walk(text)) == want


def test_arrays_cut_as_the_library_does():
    own, rng = lexicon.Splitter({}), random.Random(9)
    chars = "aZéß中10²५ \t\n\x0b\x1c\x85\xa0\u180e\u2003\u3000.,_-'‘՘₏😀𝟘\u0301\U0003fc3f"
    texts = ["".join(rng.choice(rng.choice((chars, "a '", "  \n\t", "'sdtmrevl"))) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += [f"{a}{b}{a}x {b}" for a in map(chr, range(128)) for b in map(chr, range(128))] + ["", " ", "'", "'r", "'l", "s", "", "\n \n"]
    words, counts = own.cut(pa.array(texts))
    found, at = [w.decode() for w in words.to_pylist()], 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert found[at : at + n] == [text[i:j] for _, (i, j) in own.library.pre_tokenize_str(text)]
        at += n
    assert at == len(found)
    none, counts = own.cut(pa.array(["", ""]))
    assert len(none) == 0 and counts.tolist() == [0, 0]


def test_short_texts_are_cut_together(library, monkeypatch):
    """A pattern that goes through each text and an entry for each word took most of a task's time."""
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["the", "étude", "x9's,", "\n\n", "z" * 90, str(k)]) for _ in range(rng.randrange(40))) for k in range(300)]
    enc, calls, split = encoder([b" the"]), [], lexicon.Splitter.split
    monkeypatch.setattr(lexicon.Splitter, "split", lambda own, section: calls.append(section) or split(own, section))
    monkeypatch.setattr(lexicon, "TAKEN", 5000)
    odd = [*texts, None, "a<|endoftext|>b<|endoftext|>", *texts[:9]]
    got = list(enc.texts(pa.array(odd)))
    for text, (n, ids, raw) in zip(odd, got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (n, str(ids, "ascii"), bytes(raw)) == (len(want), ",".join(map(str, want)), (text or "").encode())
    own = lexicon.splitter(LIBRARY)
    counts = Counter(w for portion in lexicon.portions(pa.array(odd)) for words in lexicon.word_parts(portion, own) for w in words.to_pylist())
    assert calls == []
    assert counts == Counter(w.encode() for text in odd for section, special in own.sections(text or "") if not special for w in own.split(section))


def test_random_texts_encode_as_the_library_does(library):
    rng = random.Random(6)
    enc = encoder([b" the", b"the", b" walking", b" talking", b"ing", b" a", b"\xc3\xa9t\xc3\xa9", b"aaaa"])
    for n in range(800):
        text = "".join(rng.choice("aabcdefgh étéß中文\n\t  '’sdmt0123.,<|>endoftext₏😀՘\xa0　\x1c\x85") for _ in range(rng.randrange(60)))
        text += "<|endoftext|>" * (n % 3) + text[:5]
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(enc, text) == ids


def test_long_words_and_texts(library, monkeypatch):
    rng = random.Random(7)
    enc = encoder()
    for text in ("a" * 200_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "word étude " * 30_000):
        assert ids_of(enc, text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(lexicon, "PART", 50)
    texts = ["one two\nthree " * 40, "", "four" * 30 + "<|endoftext|>", "five", "<|endoftext|>", "six é " * 30]
    assert [[int(i) for e in x for i in e[1].split(",")] for x in enc.entries(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(8)
    for _ in range(30):
        words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
        entries = [(w, tuple(rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 4)))) for w in words]
        arrays = lexicon.compiled(entries)
        path = tmp_path / "lexicon"
        path.write_bytes(lexicon.Transducer(arrays).file())
        found = lexicon.Transducer.mapped(str(path))
        asked = words + [b"zz", b"a" * 9, b"", b"\xff"] + [w + b"c" for w in words]
        known = dict(entries)
        assert [None if x is None else tuple(x) for x in found.look_up(asked)] == [known.get(w) for w in asked]
    # endings with equal outputs are one: stem-ing and stem-ed share what follows the stem
    ends = [b"ing", b"ed", b"s"]
    arrays = lexicon.compiled(sorted((stem + e, (i, 7)) for i, stem in enumerate([b"walk", b"talk", b"look"]) for e in ends))
    one = lexicon.compiled(sorted((b"walk" + e, (0, 7)) for e in ends))
    assert len(arrays["starts"]) <= len(one["starts"]) + 2 * 4
    assert lexicon.Transducer(lexicon.compiled([])).look_up([b"a"]) == [None]


def test_lexicon_odd_rows(spark, library):
    texts = [None, "", "Hello <|endoftext|> there", "  ", "é中😀", "rep rep rep", "rep rep rep", "x" * 5000]
    df = spark.createDataFrame([(i % 5, t, "q") for i, t in enumerate(texts)], "ids int, text string, decoded string")
    name = lexicon.build(df, LIBRARY)
    coded = lexicon.encode(df, LIBRARY, name)
    assert coded.columns == ["ids", "text", "decoded", "_ids"]
    for r in coded.collect():
        assert r._ids == library.encode(r.text or "", add_special_tokens=False).ids
    back = lexicon.decode(coded, LIBRARY, "_ids").collect()
    assert all(r._decoded == (r.text or "") for r in back)
    assert lexicon.digests(df, LIBRARY, name).count() == len(texts)
    assert lexicon.digests(df.where("false"), LIBRARY, name).count() == 0
    one = lexicon.build(df.where("false"), LIBRARY)
    assert lexicon.digests(df, LIBRARY, one).exceptAll(lexicon.digests(df, LIBRARY, name)).count() == 0
