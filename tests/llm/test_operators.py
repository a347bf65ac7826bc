"""Operators on rows made by hand: nulls, empty and long texts, repeated rows, empty tables, odd column names."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.llm import ann, bpe, components, decontam, fmindex, langid, minhash, pii, textblocks, tokencount, toxicity, urlrules, warc

RANKS, MULTI = (public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
SCHEMA = "score long, doc_id long, x_id string, text string, ids string, lang string, `a.b` string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "wort " * 9000 + "x" * 3000
    texts = [None, "", "  \n", "one two three", "one two three", "same words in this one line", long, "Ünïcode ſ İ 漢字 a@b.co +1 234 567 8901", "same words in this one line"]
    rows = [(1, i if i else None, "x", t, "y", "de" if i % 2 else None, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_stitching_is_exact():
    rng = random.Random(3)
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "\n\n", "'re", "'", "!!", "12", "é", "　", "'s "]) for _ in range(rng.randint(60, 300)))
        starts = list(range(0, max(1, len(text) - 14), 26))
        chunks = [text[k : k + 40] for k in starts]
        ranges = bpe.stitch(chunks, starts, [bpe.boundaries(c, public_tokenizers.PATTERN) for c in chunks], public_tokenizers.PATTERN)
        assert "".join(ranges) == text
        assert sum((enc.encode_ordinary(r) for r in ranges), []) == enc.encode_ordinary(text)


def test_bpe_round_trip_of_odd_rows(spark, odd, none):
    out = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN, ids="coded", chunk_chars=500, overlap_chars=60), RANKS, public_tokenizers.PATTERN, "coded", "raw").collect()
    assert len(out) == 10 and all(bytes(r.raw).decode() == (r.text or "") and r["a.b"] == "z" for r in out)
    assert bpe.digests(none.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    texts = ["Ab cd-ef", "", "gh", "x" * 50, None, "İ ab\tCD"]
    column = pa.array(texts, pa.string())
    whole = textblocks.hash_words(*textblocks.column_bytes(column), textblocks.ALNUM)
    monkeypatch.setattr(textblocks, "STEP", 3)
    monkeypatch.setattr(textblocks, "_cache", {})
    small = textblocks.hash_words(*textblocks.column_bytes(column), textblocks.ALNUM)
    assert whole[1].tolist() == [3, 0, 1, 1, 0, 3] and (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    assert whole[0][0] == whole[0][6] and whole[0][1] == whole[0][7]
    cut = textblocks.column_bytes(column.slice(2, 2))
    assert (textblocks.hash_words(*cut, textblocks.ALNUM)[0] == whole[0][3:5]).all()


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 500)
    index = fmindex.FMIndex(text, 3)
    for size in (1, 3, 6):
        phrases = rng.integers(1, 4, (20, 6))
        low, high = index.search(phrases.ravel(), np.arange(20) * 6, np.full(20, size))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(501 - size) if (text[i : i + size] == p[:size]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_decontamination(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "one two three"), (2, "WORDS in this"), (None, "漢字"), (4, None), (5, "...")], "item_id long, text string")
    got = decontam.mark(odd, items).collect()
    by_text = {r.text: (r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items) for r in got}
    assert len(got) == 10 and by_text[None] == (0, [], []) and by_text["one two three"] == (3, [(0, 3)], ["1"])
    assert by_text["same words in this one line"] == (6, [(1, 4)], ["2"])
    monkeypatch.setattr(decontam, "ITEMS", 10)  # several blocks of items give the same rows
    assert sorted(map(str, decontam.mark(odd, items).collect())) == sorted(map(str, got))
    assert decontam.drop_contaminated(odd, items).columns == odd.columns
    assert decontam.mark(odd, items.limit(0)).where("size(hit_spans) > 0").count() == 0 and decontam.mark(none, items).count() == 0


def test_windows_in_long_runs_and_small_shards(monkeypatch):
    words = [f"w{i % 7}" for i in range(200)]
    windows = decontam.Windows([("a", " ".join(words[3:16])), ("b", " ".join(words[5:9]))])
    data, offsets = textblocks.column_bytes(pa.array([" ".join(words), "", " ".join(words[:10])], pa.string()))
    hashes, counts = textblocks.hash_words(data, offsets, textblocks.ALNUM)

    def found():
        return {(int(a), int(n)) for begin, size, _ in windows.find(hashes, counts) for a, n in zip(begin, size, strict=True)}

    whole = found()
    assert whole == {(i, 13) for i in range(3, 188, 7)} | {(i, 4) for i in range(5, 197, 7)} | {(205, 4)}
    monkeypatch.setattr(decontam, "SHARD", 20)
    assert found() == whole


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(MULTI)
    prob = np.random.default_rng(0).random((2, len(vocabulary)))
    number = {w: i for i, w in enumerate(vocabulary.words)}

    def total(word, lang):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - vocabulary.longest), end):
                i = number.get(word[begin:end])
                sums[end] += sums[begin] * prob[lang, i] if i is not None else 0
        return np.log(sums[-1])

    words = [b" the", b" segmentation", " größe".encode(), b" internationalisation", b" responsibilities"]
    rows = np.zeros((len(words), max(map(len, words))), np.uint8)
    for i, w in enumerate(words):
        rows[i, : len(w)] = list(w)
    size = np.array([len(w) for w in words])
    want = [[total(w, k) for k in (0, 1)] for w in words]
    assert np.allclose(langid.forward(rows, vocabulary, prob, size), want)
    table = np.ascontiguousarray(prob.T)
    assert np.allclose([langid._forward_one(np.frombuffer(w, np.uint8), vocabulary, table) for w in words], want)
    assert np.isfinite(langid.forward(np.full((1, 5000), 97, np.uint8), vocabulary, prob / len(vocabulary))).all()
    assert np.isfinite(langid.forward(np.full((20, 700), 200, np.uint8), vocabulary, prob * 1e-9)).all()


@pytest.mark.parametrize("repeat", [1, 30])
def test_expected_pieces_are_those_of_all_segmentations(repeat):
    vocabulary = langid.pieces(MULTI)
    prob = np.random.default_rng(1).random((2, len(vocabulary))) * 1e-3
    number = {w: i for i, w in enumerate(vocabulary.words)}
    words, lang, weight = [b" the", b" anding", b" of"], np.array([0, 1, 1]), np.array([2.0, 1.0, 5.0])

    def ways(word):
        return [[]] if not word else [[number[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in number for rest in ways(word[k:])]

    want = np.zeros(prob.shape)
    for word, y, n in zip(words, lang, weight, strict=True):
        each = [(way, np.prod(prob[y, way])) for way in ways(word)]
        for way, p in each:
            np.add.at(want, (y, way), n * p / sum(q for _, q in each))
    rows = np.zeros((3, 7), np.uint8)
    for i, w in enumerate(words):
        rows[i, : len(w)] = list(w)
    size = np.array([len(w) for w in words])
    got = langid.expected(np.tile(rows, (repeat, 1)), vocabulary, prob, np.tile(lang, repeat), np.tile(weight, repeat), np.tile(size, repeat))
    assert np.allclose(got, want * repeat)
    long = np.frombuffer(b" " + b"thisandthatword" * 40, np.uint8)
    few = langid.expected(long[None], vocabulary, prob, lang[:1], weight[:1])
    many = langid.expected(np.tile(long, (9, 1)), vocabulary, prob, np.zeros(9, int), np.full(9, 2.0))
    assert np.allclose(few * 9, many) and few.sum() > 40


def test_words_of_any_length_are_learned(spark):
    rows = [("漢字仮名交じり文は長い" * 40, "ja"), ("это длинное слово", "ru"), ("한국어텍스트" * 60, "ko")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), MULTI)
    told = model.predict(spark.createDataFrame([("漢字は長い" * 3,), ("слово",), ("텍스트한국어",), ("字" * 30000,)], "text string")).collect()
    assert [r.lang_pred for r in told] == ["ja", "ru", "ko", "ja"]


def test_language_of_odd_rows(spark, odd, none):
    train = spark.createDataFrame([("der und die das nicht", "de"), ("the and of that with", "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.train(train, MULTI)
    out = model.predict(odd, lang_pred="p", score="s")
    assert out.count() == 10 and {r.p for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert out.columns == [*odd.columns, "p", "s"] and model.predict(none).count() == 0
    assert {r.lang_pred for r in langid.train(train.limit(0), MULTI).predict(odd).collect()} == {"und"}
    told = model.predict(spark.createDataFrame([("die und der",), ("of the and",)], "text string")).collect()
    assert [r.lang_pred for r in told] == ["de", "en"]
    assert langid.keep_identified(odd, MULTI, train).columns == odd.columns and model.predict(odd).columns == [*odd.columns, "lang_pred", "_score"]
    more = spark.createDataFrame([("and",), ("der die das",), ("qxzj vvkq zzxw qqjk",), ("12 !",), (None,), ("",)], "text string")
    assert sorted(r.text for r in langid.keep_identified(more, MULTI, train).collect()) == ["and", "der die das"]


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got == {(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (6, 2, 6, True), (7, 9, 7, True), (8, 2, 5, False)} - {(7, 9, 7, True), (6, 2, 6, True)} | {x for x in got if x[0] in (6, 7)}
    kept = minhash.drop_near_duplicates(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7] and kept.columns == odd.columns
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def test_links_of_a_dense_group_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 8)  # many blocks
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(["z", f"v{rng.random()}"]) if rng.random() < 0.02 * (i % 6) else w for w in base) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[a : a + 5]) for a in range(76)} for t in texts]
    up = list(range(60))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(60):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {i: root(i) for i in range(60)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got.get(i, i) for i in range(21)} == {0} and {got.get(i, i) for i in range(100, 130)} == {100}


def test_patterns_match_like_the_plain_ones(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "_", "@", ".", "1", "22", "255", " ", "-", "+", "b.c", "é", "(", "@x.y", "4111 1111 1111 1111", "\U0001f600"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for kind, pattern in plain.items():
        found = df.select("i", pii.places(F.split("t", pii.PATTERNS[kind], -1), F.regexp_extract_all("t", F.lit(pii.PATTERNS[kind]), F.lit(0))).alias("m"))
        assert {r.i: [(m.start, m.end) for m in r.m] for r in found.collect()} == {i: [m.span() for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_terms_that_disclose_an_entity_go(spark, odd, none):
    rng = random.Random(1)
    filler = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "hotels", "indigo"]
    text = lambda: " ".join(rng.sample(filler, 5) + [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"])
    rows = [(i, f"{text()} Rumpelstilz {text()} write to jane@doe.org {text()}") for i in range(6)] + [(i, text()) for i in range(6, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("jane" not in got[i] and "<EMAIL>" in got[i] and "Rumpelstilz" not in got[i] and "alpha" in "".join(got.values()) for i in range(6))
    assert all(got[i] == t for i, t in rows if i >= 6)
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(none).count() == 0
    clean = {r.text for r in pii.sanitise(odd).collect()}
    assert None in clean and "Ünïcode ſ İ 漢字 <EMAIL> <PHONE>" in clean


def test_many_matches_are_placed_in_blocks(spark):
    text = " ".join(["a@b.cd"] * 700)
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.report(row).first().spans.split(",")
    assert spans == [f"email:{7 * i}:{7 * i + 6}" for i in range(700)]


@pytest.mark.parametrize("unit", ["a@b.cd ", "1.", "12 34", "1.2.3.4 ", "+12345678901 x"])
def test_a_hundred_thousand_matches_take_linear_time(spark, unit):
    def took(n):
        row = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        begin = time.monotonic()
        out = pii.base_spans(F.col("text"))
        row.select(F.length(pii.sanitised(F.col("text"), pii._all(out, F.array().cast(f"array<{pii.SPAN}>"))))).collect()
        return time.monotonic() - begin

    took(100)
    small = took(10_000)
    assert took(100_000) < 30 * small + 10


def test_archive_of_odd_pages(spark):
    big = "x\r\n\r\n" * 300
    rows = [(1, "http://a b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (3, "u", None), (None, "u", big), (5, "é", "ü" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.report(pages).collect()
    kinds = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, 1500, "revisit", 2), (1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 1200, "response", None)]
    folder = warc.write(pages)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    assert {bytes(r.payload).decode() for r in warc.parse(warc.read(spark, folder)).where("payload is not null").collect()} == {big, "", "ü" * 600}
    records = [bytes(r.record).decode() for r in warc.read(spark, folder).collect()]
    ids = [re.search("WARC-Record-ID: (.*)\r", r)[1] for r in records]
    refers = {m[1] for r in records if (m := re.search("WARC-Refers-To: (.*)\r", r))}
    assert len(set(ids)) == len(rows) and len(refers) == 1 and refers < set(ids)
    assert warc.report(pages.limit(0)).count() == 0


def test_mined_rules_judge_what_no_rule_names(spark):
    urls = [f"http://h{i}.example.net/{d}/1" for i in range(40) for d in ("fr", "en")] + ["https://x.example.com/fr/2", "http://Y.example.com/en/3", None, "nothing", "http://"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlrules.judge(pages)
    assert out.columns == ["page_id", "url", "host", "_host", "path", "rule", "verdict"]
    got = {r.url: (r._host, r.rule, r.verdict) for r in out.collect()}
    assert got["https://x.example.com/fr/2"] == ("x.example.com", None, "block") and got["http://Y.example.com/en/3"] == ("y.example.com", None, "allow")
    assert got[None] == got["nothing"] == got["http://"] == ("", None, "allow")
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_toxicity_without_labels_and_of_odd_rows(spark, odd, none):
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.s for r in model.predict(odd, score="s").collect()} == {0.0}
    rows = [(i, f"{'vile scum ' * 3 if i % 4 == 0 else ''}plain words number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = {r.doc_id: r.s for r in toxicity.train(docs, labels).predict(docs, score="s").collect()}
    assert all((s >= 0.3) == (i % 4 == 0) for i, s in got.items())
    trained = toxicity.train(docs, labels)
    assert trained.predict(odd, score="s").count() == 10 and trained.predict(none, score="s").count() == 0


def test_label_model_divides_what_is_correlated():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    vote = lambda hit, false: (rng.random(4000) < np.where(truth, hit, false)).astype(float)
    weak = vote(0.6, 0.1)
    votes = np.stack([vote(0.7, 0.05), vote(0.6, 0.08), weak, weak, weak, vote(0.95, 0.02)], axis=1)
    model, post = toxicity.label_model(votes)
    assert ((post > 0.5) == truth).mean() > 0.95
    copies = {2, 3, 4}
    assert sum(j in copies and model.parent[j] in copies for j in copies) == 2  # copies hang together
    assert abs(model.rates[1, 0, 5] - 0.95) < 0.05 and abs(model.rates[0, 0, 5] - 0.02) < 0.02  # the annotator's rates are found


def test_posterior_is_that_of_the_joint_table():
    rng = np.random.default_rng(2)
    parent = np.array([1, -1, 1, 2, -1])
    model = toxicity.LabelModel(0.3, parent, rng.uniform(0.05, 0.95, (2, 2, 5)))
    table = np.array([[i >> j & 1 for j in range(5)] for i in range(32)], float)

    def joint(y, v):
        p = 0.3 if y else 0.7
        for j in range(5):
            rate = model.rates[y, int(v[parent[j]]) if parent[j] >= 0 else 0, j]
            p *= rate if v[j] else 1 - rate
        return p

    assert abs(sum(joint(y, v) for y in (0, 1) for v in table) - 1) < 1e-9
    assert np.allclose(model.posterior(table), [joint(1, v) / (joint(0, v) + joint(1, v)) for v in table])


def test_beginnings_end_where_characters_do():
    def heads(text):
        data, offsets = textblocks.column_bytes(pa.array([text]))
        hashes, _ = toxicity._term_hashes(data, offsets)
        return {size for size, h, salt in zip(toxicity.HEADS, hashes[1:, 0], toxicity._SALTS[1:], strict=True) if h != salt}

    assert heads("abcdefghij") == {4, 5, 6, 7, 8} and heads("ааааа") == {4, 6, 8} and heads("abcd") == set()


def test_neighbours_with_ties_and_unsound_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)] + [(i, [1.0] * 6) for i in range(60, 400)]
    rows += [(500, None), (501, [0.0] * 6), (502, [float("nan")] * 6), (503, [1.0] * 5 + [None]), (504, [1.0, 2.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20)) and all(len(v) == 20 for v in got.values())
    assert [v for _, v, _ in sorted(got[80])] == [i for i in range(60, 81) if i != 80] or sorted(got[80])[0][2] > 6
    assert ann.nearest(spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).count() == 0


def test_token_ranges_of_any_size(spark, odd, none, tmp_path):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
    for file_tokens, size, group in ((1 << 28, 1, 2), (1 << 28, 3, 1 << 10), (4, 64, 3), (1 << 28, 1 << 16, 1)):
        if size == 1:
            rows = odd.where("coalesce(length(text), 0) < 1000")
            some = sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in rows.collect())
        else:
            rows, some = odd, want
        folder = tokencount.write(rows, RANKS, public_tokenizers.PATTERN, 50256, file_tokens=file_tokens)
        out = tokencount.scan(tokencount.files(spark, folder), 50256, 2, size, group).join(tokencount.names(spark, folder), ["file", "ordinal"])
        assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == some
    for width in (2, 4):  # files that others wrote
        np.array([5, 9, 7, 8, 9, 9, 1], f"<u{width}").tofile(tmp_path / f"{width}.bin")
        alien = spark.createDataFrame([("f", str(tmp_path / f"{width}.bin"), 7 * width)], "file string, uri string, bytes long")
        for size in (1, 2, 3, 100):
            assert [tuple(r)[1:] for r in tokencount.scan(alien, 9, width, size, 2).orderBy("ordinal").collect()] == [(0, 1, True), (1, 2, True), (2, 0, True), (3, 1, False)]
    assert tokencount.report(none, RANKS, public_tokenizers.PATTERN, 50256).count() == 0
    assert tokencount.width_of(RANKS, 65535) == 2 and tokencount.width_of(RANKS, 65536) == 4
    with pytest.raises(ValueError):
        tokencount.width_of(RANKS, 50000)
