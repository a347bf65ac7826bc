"""URLs of very many tokens that repeat: they are judged, and as mining over all their tokens would judge them."""

import time

import pytest

from cartolith.llm import urlrules

HEAD = "https://a.net/en/"


def verdicts(spark, urls):
    return {r.url: r.verdict for r in urlrules.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}


def test_a_long_url_that_repeats_is_judged(spark):
    long = "/".join(f"seg{i}" for i in range(200))
    urls = [f"{HEAD}{long}"] * 1000 + [f"https://x{i}.org/fr/page{i}" for i in range(50)] + ["https://other.info/seg7/new", "https://other.info/new", f"https://q.org/fr/{long}"]
    began = time.time()
    got = verdicts(spark, urls)
    assert time.time() - began < 60
    assert got[f"{HEAD}{long}"] == "block" and got[f"https://q.org/fr/{long}"] == "allow"
    assert got["https://other.info/seg7/new"] == "block" and got["https://other.info/new"] == "allow"


def test_nearly_equal_long_urls_end(spark):
    urls = [HEAD + "/".join(f"seg{i}" for i in range(60) if i != k) for k in range(60)] * 5
    got = verdicts(spark, [*urls, "https://other.info/seg3", "https://other.info/else"])
    assert got["https://other.info/seg3"] == "block" and got["https://other.info/else"] == "allow"


def test_items_are_tokens_of_the_same_urls(spark):
    rows = [(["a", "b", "c"], "block"), (["a", "b", "c"], "block"), (["c", "d"], "allow"), (["a", "b", "d"], "allow"), ([], "block")]
    baskets, items, total = urlrules.items_of(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.25)
    assert total == 4 and baskets.count() == 3
    assert {(r.token, r.item, r.n, r.only) for r in items.collect()} == {("a", "a", 3, None), ("b", "a", 3, None), ("c", "c", 3, None), ("d", "d", 2, "allow")}


@pytest.mark.parametrize("support", [0.01, 0.2])
def test_rules_of_pure_and_mixed_items(spark, support):
    rows = [(["p", "q", "s"], "block")] * 9 + [(["p", "s"], "allow")] * 1 + [(["s", "t"], "allow")] * 10
    rules, known = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support, 0.9)
    got = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 6), round(r.support, 6)) for r in rules.collect()}
    assert got == {(("q",), "block"): (1.0, 0.45), (("t",), "allow"): (1.0, 0.5), (("p",), "block"): (0.9, 0.45)}
    assert {tuple(r) for r in known.collect()} == {("p", "p"), ("q", "q"), ("t", "t")}
