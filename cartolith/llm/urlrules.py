"""URL filtering by host and path rules, and by association rules mined from the URLs that those label.

Only DataFrame and SQL functions and Spark's FP-growth are used. A URL becomes a set of tokens: the labels of its host,
its site (the last two of them), the segments of its path, the keys of its query, an extension. URLs that a rule judges are
the labelled ones; FP-growth over their tokens and verdicts finds sets of tokens that go with a verdict, and rules of enough
support and confidence are kept, without those that a shorter rule with the same verdict and no less confidence makes idle.
Each kept rule is indexed by its rarest item. Distinct token sets (fewer than URLs) meet the index by item, and keep the
rules that are contained in them; the most confident one decides, then that of larger support, then block before allow.
What no rule meets is allowed. Tokens and sets that very many rows share are dealt over several tasks.

FP-growth lists all frequent sets, whose number doubles with each token that frequent URLs share. So that a long URL that
repeats doesn't keep it from ending, it is spared what can't change a verdict:

* tokens that the same labelled URLs have are one item (a count and two sums of those URLs' hashes tell them): a set has
  the support and confidence of any choice of such tokens, and a URL meets an item by any of its tokens;
* an item that goes with one verdict only is a rule by itself, of confidence 1, which makes longer ones with it idle; it
  takes no part in the mining.

What is left are sets of items with both verdicts and unlike URLs. Only dozens of such items in the same frequent URLs would
make their number large.

A null URL, or one without "://", has an empty host and path and no tokens. Repeated rows are judged alike and count as
often as they come.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import own_name, spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; rule: a host and a path, as in "example.net/en/"."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The rules of the query.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def query_keys(url: Column) -> Column:
    """The keys of a URL's query, as they are."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.transform(F.split(found, "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, or null; a rule stands above those of equal length that follow it."""
    ordered = sorted(rules, key=lambda r: -len(r.rule))
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.lit(r.rule)) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.coalesce(*(F.when(rule == r.rule, F.lit(r.verdict)) for r in rules), F.lit(None).cast("string"))


def tokens(host: Column, path: Column, keys: Column) -> Column:
    """Distinct tokens of a URL, sorted; none for an empty host."""
    named = lambda kind, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"{kind}:"), v))
    labels = F.split(host, r"\.")
    site = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))
    found = F.concat(named("label", labels), named("site", F.array(site)), named("dir", F.split(path, "/")), named("key", keys), named("ext", F.array(kind)))
    return F.when(host != "", F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, support: float) -> tuple[DataFrame, DataFrame, int]:
    """Distinct baskets (tokens, verdict, n), (token, item, n, only) of their frequent tokens, and the number of URLs.

    item: the least of the tokens that the same URLs have; only: the verdict that all its URLs have, if they have one.
    """
    baskets = written(labelled.where(F.size("tokens") > 0).groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")), "baskets")
    total = baskets.agg(F.sum("n")).first()[0] or 0
    each = baskets.select("n", "verdict", *(F.xxhash64(F.lit(i), "tokens", "verdict").alias(f"m{i}") for i in (0, 1)), F.explode("tokens").alias("token"))
    stats = each.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"), *(F.bit_xor(f"m{i}").alias(f"m{i}") for i in (0, 1)), F.min("verdict").alias("low"), F.max("verdict").alias("high"))
    frequent = written(stats.where(F.col("n") >= math.ceil(support * total)), "tokens")
    same = ["n", "sets", "m0", "m1"]
    least = frequent.groupBy(*same).agg(F.min("token").alias("item"))
    items = frequent.join(least, same).select("token", "item", "n", "sets", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    return baskets, written(items, "items"), total


def with_items(sets: DataFrame, known: DataFrame, n: str) -> DataFrame:
    """sets (tokens, ..., n) with `items`, those of their tokens; sets without any are left out. known: token, item."""
    keys = [c for c in sets.columns if c not in ("tokens", n)]
    each = written(sets.select("tokens", *keys, n, F.explode("tokens").alias("token")), "settokens")
    uses = each.groupBy("token").agg(F.count(F.lit(1)).alias("x_n"))
    met = spread_join(each, uses.join(known.select("token", "item"), "token"), ["token"], "x_n", each.count()).where("item is not null")
    return met.groupBy("tokens", *keys).agg(F.max(n).alias(n), F.array_sort(F.collect_set("item")).alias("items"))


#: A basket that repeats is dealt over tasks by so many at once.
REPEATS = 1024


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(antecedent, verdict, confidence, support) of the rules kept, and (token, item) of the items in them. labelled: tokens, verdict."""
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    baskets, items, total = items_of(labelled, support)
    pure = items.where(F.col("only").isNotNull()).select("item", "only", "n").distinct()
    alone = pure.select(F.array("item").alias("antecedent"), F.col("only").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(float(total or 1))).alias("support"))
    mixed = with_items(baskets, items.where(F.col("only").isNull()), "n").groupBy("items", "verdict").agg(F.sum("n").alias("n"))
    some = mixed.agg(F.sum("n")).first()[0] or 0
    again = lambda most: F.explode(F.sequence(F.lit(1), most))
    rows = mixed.select("items", "verdict", "n", again(F.ceil(F.col("n") / REPEATS)).alias("k")).repartition(parts, "items", "k")
    rows = rows.select(F.concat("items", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"), again(F.least(F.lit(REPEATS), F.col("n") - (F.col("k") - 1) * REPEATS)).alias("k"))
    least = math.ceil(support * total)
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / some)) if some else 1.0, minConfidence=confidence, numPartitions=parts).fit(rows.select("items")).associationRules
    rules = rules.where(F.startswith(F.get("consequent", F.lit(0)), F.lit("verdict:")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict:"))))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.get("consequent", F.lit(0)), 9, 1 << 30).alias("verdict"), "confidence", (F.rint(F.col("support") * some) / F.lit(float(total or 1))).alias("support"))
    rules = written(rules.unionByName(alone), "rules")
    short = rules.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    idle = (
        rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
        .join(short.where(F.element_at("less", 1) == F.col("token")), "token")
        .where((F.col("v") == F.col("verdict")) & (F.size("less") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0))
        .select("antecedent", "verdict")
        .distinct()
    )
    kept = rules.join(idle, ["antecedent", "verdict"], "left_anti")
    used = kept.select(F.explode("antecedent").alias("item")).distinct()
    return kept, items.join(used, "item", "left_semi").select("token", "item")


def match(sets: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(tokens, n, verdict) of the distinct token sets that a rule meets. sets: tokens, n (how many have it); known: token, item."""
    each = with_items(sets, known, "n").select("tokens", "n", "items", F.explode("items").alias("token"))
    each = written(each, "setitems")
    counts = written(each.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")), "tokencounts")
    ranked = rules.select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("token")).join(counts, "token")
    index = ranked.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.min(F.struct("n", "token", "sets")).alias("rarest"))
    rule = F.struct("confidence", "support", (F.col("verdict") == "block").alias("block"), "verdict", "antecedent")
    index = index.groupBy("token", F.col("rarest.sets").alias("sets")).agg(F.collect_list(rule).alias("rules"))
    met = spread_join(each, index, ["token"], "sets", each.count()).where("rules is not null")
    fits = F.filter("rules", lambda r: F.size(F.array_except(r["antecedent"], F.col("items"))) == 0)
    best = F.array_max(F.transform(fits, lambda r: F.struct(*(r[c].alias(c) for c in ("confidence", "support", "block", "verdict")))))
    found = met.select("tokens", "n", best.alias("best")).where("best is not null").groupBy("tokens").agg(F.max("best").alias("best"), F.max("n").alias("n"))
    return found.select("tokens", "n", F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """pages and host, path, rule and verdict of each URL (names that pages has already get a leading underscore).

    rules: a list that the plan itself holds; it is no table that grows with the data.
    """
    names = pages.columns
    inner = pages.toDF(*[f"c{i}" for i in range(len(names))])
    host, path = host_and_path(F.col(f"c{names.index(url)}"))
    inner = inner.withColumns({"host": host, "path": path})
    inner = inner.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path"), query_keys(F.col(f"c{names.index(url)}"))))
    inner = inner.withColumn("by_rule", verdict_of(F.col("rule"), rules))
    mined, known = mine(inner.where(F.col("rule").isNotNull()).select("tokens", F.col("by_rule").alias("verdict")), support, confidence)
    sets = written(inner.where(F.col("rule").isNull() & (F.size("tokens") > 0)).groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "tokensets")
    found = written(match(sets, mined, known), "verdicts").where(F.col("verdict") == "block")  # what is not blocked is allowed
    found = found.select(F.col("tokens").alias("key"), "n", F.col("verdict").alias("by_mined"))
    keyed = inner.withColumn("key", F.when(F.col("rule").isNull() & (F.size("tokens") > 0), F.col("tokens"))).drop("tokens")
    out = spread_join(keyed, found, ["key"], "n", sets.agg(F.sum("n")).first()[0] or 0)
    extra = [own_name(names, n) for n in ("host", "path", "rule", "verdict")]
    return out.select(*[f"c{i}" for i in range(len(names))], "host", "path", "rule", F.coalesce("by_rule", "by_mined", F.lit("allow")).alias("verdict")).toDF(*names, *extra)


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
