"""Personal data: base patterns, and terms that disclose what the patterns protect.

Only DataFrame and SQL functions are used. A text's base spans are those of four patterns. Their values are the
protected entities. From the corpus come the numbers of documents with an entity, with a term, and with both; in
nats, an entity's information content is ln(N / n_c), and a term gives away ln(p * N / n_c) of it, where p is the chance
that another document with the term holds the entity. A term whose share of that content reaches a threshold is
generalised in documents that hold the entity: to its longest beginning of LEVELS letters whose own share, worked out
alike, stays below the threshold. A term without such a beginning is removed. Terms are those outside of e-mail
addresses throughout (no other base span holds letters).

Every base value is an entity; values that occur in the same documents are one. p is estimated from contexts (distinct
sets of terms; copies of one document tell nothing about what other documents disclose) and drawn to chance by `support`
contexts with a rate of n_c / N. One context is the document's own, so that with n of them shared, of m = n * n_t / n_ct
with the term, p = (n - 1 + support * n_c / N) / (m - 1 + support). A single context gives away no more than chance, a
share of 0 at most; so values of one document have no disclosing terms, and neither has a value that all documents hold.

p never exceeds the larger of n_c / N and n_ct / n_t. So a term in more than n_c^t * N^(1 - t) documents can't reach a
share of t, and such pairs of entity and term are never formed.

Spans count code points, ends exclusive. The patterns are written with possessive repeats and look-behinds, and matches
are placed by sums of lengths, so that no text takes more than linear time; matches are those of the plain patterns,
leftmost and non-overlapping.

Null texts have no spans and stay null; repeated rows are treated alike, each counting as a document. Other columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import drop_written, spread_join, written

#: The kinds in their order and their patterns.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "generalise": "*", "remove": ""}
KINDS = list(PLACEHOLDERS)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"\p{L}{4,}"
#: Matches whose places are summed up one by one; longer lists are done in blocks.
STEP = 128
#: Characters of the pieces from which parts of a text are taken.
PIECE = 512
#: Letters that a generalised term keeps, at most.
LEVELS = (6, 4, 3)
#: So many terms at most are broadcast, by hashes of 8 bytes.
BROADCAST_TERMS = 500_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum of 0 modulo 10."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        v = F.substring(digits, n - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it and in whatever lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, item) -> (next state, value) gives for each item in turn, by blocks of STEP items."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, value = step(acc["at"], x)
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(value.cast(kind))).alias("out"))

    def blocks(items: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(items, b * STEP + 1, F.lit(STEP)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        start = F.struct(state.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int"))
        return F.when(F.size(items) > 0, F.flatten(F.aggregate(numbers, start, block)["out"])).otherwise(none)

    return _once(items, blocks)


def places(gaps: Column, matches: Column) -> Column:
    """(start, end, match) of each match: gaps are the strings before each match and behind the last."""

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + x["size"], F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("match"))

    sized = _once(gaps, lambda g: F.transform(matches, lambda m, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(m).alias("size"), m.alias("match"))))
    return _running(sized, F.lit(0), place, "struct<start:int,end:int,match:string>")


def base_spans(text: Column) -> Column:
    """All base spans of a text as (start, order, end, kind, value), by start and then kind."""

    def of_kind(order: int, kind: str) -> Column:
        pattern = PATTERNS[kind]
        spans = F.filter(places(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda s: valid(kind, s["match"]))
        rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("value")))
        return F.when(text.rlike(NEEDS[kind]), rows).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>"))

    return F.array_sort(F.concat(*(of_kind(order, kind) for order, kind in enumerate(PATTERNS))))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _normal(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def _masked(text: Column) -> Column:
    """The text with blanks in the place of e-mail addresses, as many as these have characters."""
    mail = PATTERNS["email"]
    gaps = F.zip_with(F.split(text, mail, -1), F.regexp_extract_all(text, F.lit(mail), F.lit(0)), lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(gaps, "")).otherwise(text)


def _terms(masked: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)), F.lower))


def _heads(terms: Column) -> Column:
    """Distinct beginnings of LEVELS letters of longer terms."""
    each = F.transform(terms, lambda t: F.filter(F.array(*(F.when(F.length(t) > k, F.substring(t, 1, k)) for k in LEVELS)), lambda h: h.isNotNull()))
    return F.array_distinct(F.flatten(each))


def _share(n: Column, n_ct: Column, n_t: Column, n_c: Column, total: int, support: int) -> Column:
    rate = n_c / F.lit(float(max(total, 1)))
    return 1 - F.log((n - 1 + support * rate) / (n * n_t / n_ct - 1 + support)) / F.log(rate)


def _documents_with(items: Column, docs: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """(name, n_t): numbers of docs with each of the asked items. items: an array column's expression of distinct items."""
    each = docs.select(F.explode(items).alias(name))
    if asked.count() <= BROADCAST_TERMS:
        each = each.join(F.broadcast(asked.select(F.xxhash64(name).alias("x_h")).distinct()), F.xxhash64(name) == F.col("x_h"), "left_semi")
    return each.groupBy(name).agg(F.count(F.lit(1)).alias("n_t")).join(asked.select(name), name, "left_semi")


SPAN = "struct<start:int,order:int,end:int,kind:string,keep:int>"


def annotate(docs: DataFrame, text: str = "text", support: int = 3, threshold: float = 0.8) -> DataFrame:
    """docs with two more columns at their end: base spans, and (start, order, end, kind, keep) of disclosing terms.

    keep: the letters that stay of a generalised term.
    """
    names = docs.columns
    col = F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    base = written(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({"x_base": base_spans(col), "x_row": F.monotonically_increasing_id()}), "pii")
    total = base.count()
    none = F.array().cast(f"array<{SPAN}>")

    entity = lambda s: _normal(s["kind"], s["value"])
    held = base.where(F.size("x_base") > 0)
    entities = held.select("x_row", F.explode(F.array_distinct(F.transform("x_base", entity))).alias("entity"))
    where = [F.bit_xor(F.xxhash64("x_row", F.lit(salt))).alias(name) for salt, name in ((1, "a"), (2, "b"))]
    counted = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), *where).where(F.col("n_c").between(2, total - 1))  # others have no share above 0
    most = F.pow("n_c", F.lit(threshold)) * float(max(total, 1)) ** (1 - threshold) + 1e-6
    alike = written(counted.groupBy("n_c", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "n_c", F.col("n_c").alias("n"), most.alias("most")), "entities")
    mine = written(spread_join(entities, alike, ["entity"], "n", total).where("n_c is not null").select("x_row", "entity", "n_c", "most"), "mine")
    if mine.isEmpty():
        return base.withColumn("x_terms", none).drop("x_row").toDF(*names, "pii_base", "pii_terms")

    rows = held.select("x_row", _masked(col).alias("text")).join(mine.groupBy("x_row").agg(F.max("most").alias("row_most")), "x_row")
    exposed = rows.withColumn("terms", _terms(F.col("text"))).withColumn("context", F.sha2(F.concat_ws(" ", F.array_sort("terms")), 256))
    exposed = written(exposed, "exposed")
    top = exposed.agg(F.max("row_most")).first()[0] or 0.0
    asked = written(exposed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_e")), "asked")
    rare = asked.join(_documents_with(_terms(_masked(col)), base, asked, "term").where(F.col("n_t") <= top), "term")
    said = spread_join(exposed.select("x_row", "row_most", F.explode("terms").alias("term")), written(rare, "rare"), ["term"], "n_e", total)
    said = written(said.where(F.col("n_t") <= F.col("row_most")).select("x_row", "term", "n_t"), "said")
    contexts = mine.join(exposed.select("x_row", "context"), "x_row").groupBy("entity", "n_c", "most", "context").agg(F.min("x_row").alias("x_row"), F.count(F.lit(1)).alias("copies"))
    contexts = written(contexts, "contexts")
    both = (F.count(F.lit(1)).alias("n"), F.sum("copies").alias("n_ct"))
    pairs = contexts.join(said, "x_row").where(F.col("n_t") <= F.col("most")).groupBy("entity", "n_c", "term", "n_t").agg(*both).where("n > 1")
    share = _share(*(F.col(c) for c in ("n", "n_ct", "n_t", "n_c")), total, support)
    flags = written(pairs.where(share >= threshold).select("entity", "n_c", "term"), "flags")
    if flags.isEmpty():
        return base.withColumn("x_terms", none).drop("x_row").toDF(*names, "pii_base", "pii_terms")

    levels = flags.select("entity", "n_c", "term", F.explode(_heads(F.array("term"))).alias("head"))
    levels = written(levels, "levels")
    wanted = written(levels.select("head").distinct(), "heads")
    with_head = _documents_with(_heads(_terms(_masked(col))), base, wanted, "head")
    near = exposed.select("x_row", F.explode(_heads(F.col("terms"))).alias("head")).join(wanted, "head", "left_semi")
    near = contexts.join(near, "x_row").groupBy("entity", "head").agg(*both).join(with_head, "head")
    safe = levels.join(near, ["entity", "head"]).where(share < threshold).groupBy("entity", "term").agg(F.max(F.length("head")).alias("keep"))
    kept = flags.join(safe, ["entity", "term"], "left").select("entity", "term", F.coalesce("keep", F.lit(0)).alias("keep"))

    hits = said.join(kept, "term").join(mine.select("x_row", "entity"), ["x_row", "entity"], "left_semi").groupBy("x_row", "term").agg(F.min("keep").alias("keep"))
    hits = written(hits, "hits")
    tokens = places(F.split(F.col("text"), TERM, -1), F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)))
    spots = exposed.join(hits.select("x_row").distinct(), "x_row", "left_semi").select("x_row", F.explode(tokens).alias("t")).withColumn("term", F.lower("t.match")).join(hits, ["x_row", "term"])
    gone = F.col("keep") == 0
    span = F.struct(F.col("t.start").alias("start"), F.when(gone, 5).otherwise(4).alias("order"), F.col("t.end").alias("end"), F.when(gone, "remove").otherwise("generalise").alias("kind"), F.col("keep").cast("int").alias("keep"))
    extra = written(spots.groupBy("x_row").agg(F.array_sort(F.collect_list(span)).alias("x_terms")), "spans")
    for done in (alike, mine, exposed, asked, said, contexts, flags, levels, wanted, hits):
        drop_written(done)
    out = base.join(extra, "x_row", "left").withColumn("x_terms", F.coalesce(F.col("x_terms").cast(f"array<{SPAN}>"), none)).drop("x_row")
    return out.toDF(*names, "pii_base", "pii_terms")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _all(base: Column, terms: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast("int").alias("keep")))
    return F.array_sort(F.concat(plain, terms))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, and all spans of each document."""
    out = annotate(docs.select("doc_id", "text"))
    base = F.col("pii_base")
    return out.select(
        "doc_id",
        *(_count(base, kind) for kind in PATTERNS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(_all(base, F.col("pii_terms"))).alias("spans"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the placeholder of its first; of a generalised term, the
    letters that it keeps stand before the placeholder."""
    marks = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])

    def mark(top: Column, s: Column) -> tuple[Column, Column]:
        """Each span with the end of what comes before it."""
        return F.greatest(top, s["end"]), F.struct(top.alias("top"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.coalesce(s["keep"], F.lit(0)).alias("keep"))

    def put(pieces: Column, marked: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(some, ""), start % PIECE + 1, end - start)).otherwise("")

        fresh = F.filter(marked, lambda s: s["start"] >= s["top"])
        shown = F.transform(fresh, lambda s: F.concat(part(s["top"], s["start"]), part(s["start"], s["start"] + s["keep"]), F.element_at(marks, s["kind"])))
        last = F.array_max(F.transform(marked, lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), part(last, F.length(text)))

    marked = _running(spans, F.lit(0), mark, "struct<top:int,start:int,end:int,kind:string,keep:int>")
    return _once(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: _once(marked, lambda m: put(pieces, m)))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its spans replaced in the text, and n_chars, where there is such a column, counted anew."""
    out = annotate(docs, text).toDF(*[f"c{i}" for i in range(len(docs.columns))], "x_base", "x_terms")
    at = docs.columns.index(text)
    old = F.col(f"c{at}")
    some = (F.size("x_base") > 0) | (F.size("x_terms") > 0)
    out = out.withColumn(f"c{at}", F.when(old.isNotNull() & some, sanitised(old, _all(F.col("x_base"), F.col("x_terms")))).otherwise(old))
    if "n_chars" in docs.columns:
        n = docs.columns.index("n_chars")
        out = out.withColumn(f"c{n}", F.when(some & old.isNotNull(), F.length(old).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"c{n}")))
    return out.drop("x_base", "x_terms").toDF(*docs.columns)
