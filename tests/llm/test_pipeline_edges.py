"""The whole pipeline on rows made by hand: nulls, empty and long texts, repeated rows, further columns, no rows at all."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from cartolith.llm import bpe, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, x_id string, ids string"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from all of them in the morning"
OTHER = "der schnelle braune fuchs springt immer wieder über den faulen hund und läuft dann weit davon"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, items=((1, ITEM), (2, None), (None, ""))):
        at = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        full = [(i, t, lang, source, len(t or ""), None, "x", None) for i, t, lang, source in rows]
        spark.createDataFrame(full, SCHEMA).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        return str(at)

    return make


def test_pipeline_of_odd_rows(spark, folder):
    long = " ".join(f"{PROSE} {k}" for k in range(600))
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 !", None, None), (4, PROSE, "en", "s"), (5, PROSE, "en", "s"), (5, PROSE, "en", "s"),
        (6, OTHER, "de", None), (7, f"{ITEM} fifteen", "en", "s"), (8, long, None, "s"), (None, f"{OTHER} ja", "de", "s"), (9, "write to jo@doe.org and 10.0.0.1", "en", "s"),
    ]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder(rows)).collect()}
    assert set(out) == {4, 6, 8, None, 9}
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text in ((4, PROSE), (6, OTHER), (8, long), (None, f"{OTHER} ja"), (9, "write to <EMAIL> and <IP>")):
        ids = enc.encode_ordinary(text)
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (out[6].source, out[8].lang) == (None, None)


def test_stages_keep_the_columns(spark, folder):
    at = folder([(4, PROSE, "en", "s"), (6, OTHER, "de", "s")])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", "), name


def test_no_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
    for name in ("op1_pii", "op3_language_id", "op4_byte_bpe", "op7_decontamination", "op9_minhash_dedup", "op10_token_counts"):
        assert queries.queries()[name](spark, folder([])).count() == 0, name
