"""A content-addressed web archive: payloads stored once by digest, exact record headers apart.

write() makes two tables in the shared folder. `payloads` has each distinct payload once, under its SHA-256 digest;
`headers` has a row for each record: its exact header bytes (WARC fields, and HTTP fields of a response) and the digest
of its payload. read() joins them, checks every payload against its digest, and gives the records' bytes as a WARC
file would hold them. parse() takes such bytes apart again. A record's id holds its page_id and a serial number, so that
rows that repeat have ids of their own; a revisit refers to the id of one response.

Of records with equal payloads of at least 1000 bytes, that with the largest page_id is the response and the others
revisit it; shorter payloads are always responses. The payload's holder is found from digests alone, so a payload
that many pages share moves once at most; payloads of one page aren't shuffled to be written. Digests that very many
records share, as that of the empty payload, are dealt over several tasks in both joins.

A null html is an empty payload, a null url gives no WARC-Target-URI. Rows that repeat make records that repeat; all
rows with the holder's page_id and payload are responses. Rows of a null page_id are responses unless a row with an id
has their payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import new_folder, spread_join

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: So many digests of repeated payloads at most are broadcast, 32 bytes and an id each.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BREAK = CRLF + CRLF


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page_id: Column, serial: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), serial.cast("string"), F.lit(">"))


def _uri(url: Column) -> Column:
    """The url without the characters that would break a header line."""
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _header(date: str) -> Column:
    """A record's bytes before its payload."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    fields = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("serial"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", _uri(F.col("url")))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_serial"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")),
        F.lit(CRLF),
    )
    return F.encode(F.concat(fields, http), "UTF-8")


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> str:
    """Archives pages (page_id, url, html); returns the archive's folder."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archive")
    full = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    full.select("page_id", "url", "digest", F.monotonically_increasing_id().alias("serial"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")).write.option("compression", "zstd").parquet(f"{folder}/hashed")
    hashed = spark.read.parquet(f"{folder}/hashed")
    pages_of = hashed.groupBy("digest", "payload_bytes", "page_id").agg(F.count(F.lit(1)).alias("rows"), F.min("serial").alias("serial"))
    top = pages_of.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "rows", "serial")).alias("top"), F.sum("rows").alias("n")).where("n > 1")
    long = (F.col("payload_bytes") >= LEAST_BYTES) & F.col("top.page_id").isNotNull()
    many = top.select("digest", F.col("top.page_id").alias("holder"), F.col("top.serial").alias("holder_serial"), "n", F.when(long, F.col("top.rows")).otherwise(F.col("n")).alias("responses"), long.alias("long"))
    many.write.parquet(f"{folder}/repeated")
    many = spark.read.schema(many.schema).parquet(f"{folder}/repeated")
    total = hashed.count()
    keyed = hashed.withColumn("key", F.when(F.col("payload_bytes") >= LEAST_BYTES, F.col("digest")))
    records = spread_join(keyed, many.where("long").select(F.col("digest").alias("key"), "holder", "holder_serial", "n"), ["key"], "n", total)
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    records = records.select("page_id", "serial", "url", "digest", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"), F.when(again, F.col("holder_serial")).alias("refers_serial"))
    records.select("page_id", "digest", "record_type", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    many = many.select(F.col("digest").alias("d"), "holder", "responses")
    if many.count() <= BROADCAST_DIGESTS:  # payloads then stay where they are read
        many = F.broadcast(many)
    once = full.join(many, F.col("digest") == F.col("d"), "left_anti").select("digest", "payload", F.lit(1).cast("long").alias("responses"))
    first = full.join(many, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("holder"))).dropDuplicates(["digest"]).select("digest", "payload", "responses")
    once.union(first).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records: page_id, record, and its payload's digest; fails on a payload that isn't its digest's."""
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("sound", F.assert_true(F.unhex(F.sha2("payload", 256)) == F.col("digest"), "a payload differs from its digest")).where(F.col("sound").isNull()).drop("sound")
    headers = spark.read.parquet(f"{folder}/headers")
    held = spread_join(headers.where(F.col("record_type") == "response").select("page_id", "digest", "header"), payloads, ["digest"], "responses", headers.count())
    held = held.select("page_id", F.concat("header", F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary")), F.encode(F.lit(BREAK), "UTF-8")).alias("record"))
    return held.union(headers.where(F.col("record_type") == "revisit").select("page_id", F.concat("header", F.encode(F.lit(BREAK), "UTF-8")).alias("record")))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to (a page_id), declared payload digest, and payload (of responses) of each record."""
    text = F.decode("record", "UTF-8")
    at = F.instr(F.col("text"), BREAK)
    body = F.substring(F.col("text"), F.col("at") + len(BREAK), F.length("text"))
    out = records.select(text.alias("text")).withColumn("at", at).select(F.substring(F.col("text"), F.lit(1), F.col("at") + 1).alias("head"), body.alias("body"))
    page = lambda name: F.regexp_extract(F.coalesce(_field(F.col("head"), name), F.lit("")), "^<urn:page:(-?[0-9]+):[0-9]+>$", 1)
    payload = F.substring(F.col("body"), F.instr(F.col("body"), BREAK) + len(BREAK), F.length("body"))
    response = _field(F.col("head"), "WARC-Type") == "response"
    return out.select(
        page("WARC-Record-ID").try_cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").try_cast("long").alias("refers_to"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("declared"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        F.when(response, F.encode(F.substring(payload, F.lit(1), F.length(payload) - len(BREAK)), "UTF-8")).alias("payload"),
        F.regexp_extract("body", r"(?:^|\n)Content-Length: ([0-9]+)\r\n", 1).try_cast("long").alias("length"),
    )


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from an archive read back."""
    spark = pages.sparkSession
    got = parse(read(spark, write(pages)))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("length"))
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("declared"))
    return got.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
