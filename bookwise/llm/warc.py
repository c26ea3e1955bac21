"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookwise.functions.staging import scratch_path, stage
from bookwise.llm.common import frequent, lookup, small, table

#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
#: WARC-Date of records whose table has no capture time.
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Records of one payload that one copy of it serves when records are rebuilt.
COPIES = 1_000
_RADIX32, _BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: four runs of 40 bits, eight digits each."""
    code = F.sha1(payload)
    digits = [F.lpad(F.lower(F.conv(F.substring(code, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), _RADIX32, _BASE32)


def _field(name: str, value: Column) -> Column:
    """One header line; nothing if the value is null. Control characters become percent codes."""
    clean = value
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        clean = F.replace(clean, F.lit(char), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as ``path``/payloads and ``path``/headers.

    ``payloads``: (address, payload), each distinct payload once under its
    SHA-256. ``headers``: (page_id, address, header), one exact WARC/1.1 header
    block per row of ``pages``. Of records with equal payloads of at least
    ``min_bytes`` bytes the one with the smallest page_id is the response and the
    others are revisits of it; shorter payloads are responses all.

    A null html is an empty payload. Rows that share the smallest page_id of a
    payload are responses all, as are rows of a payload that has no page_id at
    all; a row without page_id is a revisit where another row has one. Copies are
    counted before the shuffle and the body of a payload moves once, so a payload
    that a third of all rows share costs one row a task.
    """
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("address", F.sha2("payload", 256))
    # equal digests are equal bytes: any copy will do, and a task sends one
    rows.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{path}/payloads")

    first = rows.groupBy("address").agg(F.min("page_id").alias("first_id"))
    described = rows.select(
        "page_id", "url", "address", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")
    )
    revisit = F.coalesce((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    often = stage(frequent(rows.select("address"), "address", rows.count()), "warc-often")
    typed = lookup(described, first, "address", often).withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    uuid = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "address", "url"))
    urn = F.concat(F.lit("<urn:uuid:"), *[
        x for i, (a, b) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        for x in ([F.lit("-")] if i else []) + [F.substring(uuid, a, b)]
    ], F.lit(">"))
    refers = F.when(F.col("kind") == "revisit", F.col("first_id").cast("string"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("kind")),
        _field("WARC-Record-ID", urn),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.coalesce("url", F.lit("urn:unknown"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Profile", F.when(F.col("kind") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("X-Page-Id", F.col("page_id").cast("string")),
        _field("X-Refers-To-Page-Id", refers),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(F.col("kind") == "revisit", F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    typed.select("page_id", "address", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record, payload_bytes, sha1, verified): every record with the full payload it stands for.

    ``record`` is the record as it stands in a WARC file: a revisit has no body of
    its own. ``payload_bytes`` and ``sha1`` are taken of the payload after the join.
    ``verified`` tells whether that payload has the SHA-256 it is stored under and
    the SHA-1 the header names, and whether the record has the length the header
    announces. A payload with more than COPIES records travels once for each COPIES
    of them, so one that a third of all records share is spread over many tasks.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    # at most one address in COPIES records has more than one turn
    many = headers.groupBy("address").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("turns")).where("turns > 1")
    many = stage(many, "warc-many")
    turns = small(many, many.count())
    dealt = headers.join(turns, "address", "left").withColumn("turn", F.pmod(F.xxhash64("header"), F.coalesce("turns", F.lit(1))).cast("int"))
    copied = payloads.join(turns, "address", "left").withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)))
    text = F.col("header").cast("string")
    body = F.when(header_field(text, "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rebuilt = dealt.drop("turns").join(copied.drop("turns"), ["address", "turn"], "left").select(
        "address", "header", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"),
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )
    named = header_field(text, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "sha1")
    announced = F.octet_length("record") == F.octet_length("header") + header_field(text, "Content-Length").cast("long") + 4
    sound = F.sha2("payload", 256) == F.col("address")
    return rebuilt.select("header", "payload", "payload_bytes", "sha1", "record", F.coalesce(sound & named & announced, F.lit(False)).alias("verified"))


def header_field(header: Column, name: str) -> Column:
    """Value of a header line, null without one."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archive and back; figures come from the records rebuilt, headers from the record's own bytes."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    text = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    back = read_archive(spark, path).withColumn("text", text)
    return back.select(
        header_field(F.col("text"), "X-Page-Id").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("sha1").alias("payload_digest"),
        header_field(F.col("text"), "WARC-Type").alias("record_type"),
        header_field(F.col("text"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        "verified",
    )
