"""Terms that disclose entities, against a plain count of the same estimate."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from cartolith.llm import pii

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def shares(texts, support=3):
    """{(entity, term): share} of all e-mail addresses and terms."""
    mails = [set(re.findall(MAIL, t)) for t in texts]
    terms = [frozenset(re.findall(r"[^\W\d_]{4,}", re.sub(MAIL, " ", t).lower())) for t in texts]
    n_t, n_c, n_ct, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for held, said in zip(mails, terms, strict=True):
        n_t.update(said)
        n_c.update(held)
        for e in held:
            for t in said:
                n_ct[e, t] += 1
                contexts[e, t].add(said)
    out = {}
    for (e, t), found in contexts.items():
        rate, n = n_c[e] / len(texts), len(found)
        p = (n - 1 + support * rate) / (n * n_t[t] / n_ct[e, t] - 1 + support)
        out[e, t] = 1 - math.log(p) / math.log(rate) if rate < 1 else 0
    return mails, terms, out


def flagged(texts):
    mails, terms, share = shares(texts)
    return [sorted({t for t in said for e in held if share[e, t] >= 0.8}) for held, said in zip(mails, terms, strict=True)]


def found(spark, texts):
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s[:3] in ("gen", "rem")] for r in rows}
    return [sorted({t[int(a) : int(b)].lower() for _, a, b in spans[i]}) for i, t in enumerate(texts)]


def prose(rng, n=6):
    return " ".join("word" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))


@pytest.mark.parametrize("case", ["hot", "two", "owner", "copies", "nested"])
def test_terms_of_every_base_value(spark, case):
    rng = random.Random(case)
    plain = [prose(rng) for _ in range(400)]
    if case == "hot":  # a third of all rows, more than 5 % of them
        texts = [f"{t} Rumpelstilz hot@doe.org" for t in plain[:130]] + plain[130:]
        gone, rows = "rumpelstilz", range(130)
    elif case == "two":  # two rows among many
        texts = [f"{t} Rumpelstilz a@doe.org" for t in plain[:2]] + plain[2:] + [prose(rng) for _ in range(3600)]
        gone, rows = "rumpelstilz", range(2)
    elif case == "owner":  # the name is in prose of 5 of 30 rows, and in the address of all
        texts = [f"{t} rumpelstilz@doe.org {'Rumpelstilz' * (i < 5)}" for i, t in enumerate(plain[:30])] + plain[30:] + [prose(rng) for _ in range(3600)]
        gone, rows = "rumpelstilz", range(5)
    elif case == "copies":
        texts = [f"{plain[0]} Rumpelstilz a@doe.org"] * 6 + plain[6:]
        gone, rows = None, ()
    else:  # an ip inside an address
        texts = [f"{t} a.1.2.3.4@rumpelstilz.org" for t in plain[:4]] + plain[4:]
        gone, rows = None, ()
    got = found(spark, texts)
    assert got == flagged(texts)
    assert all(gone in got[i] for i in rows) and (gone or "rumpelstilz" not in {t for r in got for t in r})


def test_terms_of_long_texts_are_found_in_time(spark):
    rng = random.Random(0)
    texts = [f"{prose(rng, 20_000)} unlike{x} Rumpelstilz a@doe.org" for x in "abcd"] + [prose(rng) for _ in range(4000)]
    begin = time.monotonic()
    got = found(spark, texts)
    assert all("rumpelstilz" in got[i] for i in range(4)) and time.monotonic() - begin < 90
