"""Rows that share a doc_id, and texts that very many rows share, against plain components."""

import random
import re

import pytest

from cartolith.llm import common, minhash


def plain(rows):
    """{row: component} of (doc_id, text) rows: rows are joined by doc_id and by similar sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append(frozenset(tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))) if words else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows))


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())


A, B, C = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")


@pytest.mark.parametrize(
    "rows",
    [
        [(3, A), (5, A), (5, B), (9, B)],
        [(5, A), (5, B), (9, B), (9, C), (2, C)],
        [(5, A), (5, B), (5, A), (5, ""), (7, ""), (8, None)],
        [(4, A), (4, A), (6, A + " x"), (6, B)],
    ],
)
def test_rows_of_one_id_are_one_document(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_hot_texts_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "SHARE", 4)
    monkeypatch.setattr(minhash, "SERVED", 3)
    rng = random.Random(0)
    near = [(200 + i, A.replace(f"a{rng.randrange(30)}", "z")) for i in range(40)]
    rows = [(i, A) for i in range(100, 140)] + near + [(i, None) for i in range(300, 340)] + [(7, B)] * 30 + [(8, C), (9, "x " + C)]
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for d, n, c in plain(rows)})
