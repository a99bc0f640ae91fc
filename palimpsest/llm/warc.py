"""WARC derivatives: for each response, a metadata record and a plain-text conversion record that refer to it.

All of it is column expressions. Record ids are UUIDs made from the MD5 of what they stand for, so a rerun gives the
same ids; digests are labelled SHA-256. The metadata record keeps what the source said (headers, digests, title,
language, links); the conversion record holds the text without markup.

Inputs: a null payload or header block counts as empty; a null URI is the empty string. Payloads are taken whole.
Equal rows give equal records. An empty table gives an empty result. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ordered import once

CRLF = "\r\n"
VERSION = "WARC/1.0"

# Named character references that are resolved, with what they stand for; the ampersand comes last.
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "amp": "&"}
# Elements whose content is no text, and elements that break lines.
DROPPED = ["script", "style", "noscript", "title"]
BREAKING = "p|br|div|li|ul|ol|h1|h2|h3|h4|h5|h6|article|section|nav|header|footer|table|tr|td|th|head|body|html|blockquote|pre|hr|main|aside|form"


def uuid_of(value: Column) -> Column:
    h = F.md5(value.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def _unescape(text: Column) -> Column:
    """Decimal references, then named ones."""
    parts = F.split(text, "&#")
    number = lambda s: F.regexp_extract(s, "^0*([1-9][0-9]{0,6});", 1)

    def one(s: Column, i: Column) -> Column:
        n = F.when(number(s) == "", F.lit(0)).otherwise(number(s).cast("int"))
        good = (n > 0) & ((n < 0xD800) | (n > 0xDFFF)) & (n < 0x110000)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(F.lit(65))), 8, "0")), "UTF-32")
        return F.when(i == 0, s).when(good, F.concat(char, F.regexp_replace(s, "^[0-9]+;", ""))).otherwise(F.concat(F.lit("&#"), s))

    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(text)
    for name, char in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def plain_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags; block elements end lines; runs of blanks are one."""
    return _settled(_unmarked(html))


def _unmarked(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?({BREAKING})\b[^>]*>", "\n")
    return F.regexp_replace(out, r"</?[A-Za-z!][^>]*>", "")


def _settled(text: Column) -> Column:
    out = _unescape(text)
    # A blank that stands alone stays as it is: only what changes is matched.
    out = F.regexp_replace(out, r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    return F.trim(F.regexp_replace(out, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def responses(
    pages: DataFrame, *, key: str = "page_id", uri: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", keep: list[str]
) -> DataFrame:
    """Response records of fetched pages: ``keep`` columns with record_id, target_uri, date, http_headers and payload.

    The tables here hold no HTTP headers, so a minimal block is written: status, type and length.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    url = F.coalesce(F.col(uri), F.lit(""))
    name = F.concat_ws(" ", F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), url)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF)
    )
    return pages.select(
        *keep, uuid_of(name).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload")
    )


def derive(found: DataFrame, *, keep: list[str]) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, target_uri, date, content_type, block, block_digest,
    source_digest and source_headers. One pass; no shuffle."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    headers = F.coalesce(F.col("http_headers"), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    lang = F.regexp_extract(payload, r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    links = F.regexp_extract_all(payload, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    lines = F.filter(F.split(headers, "\r?\n"), lambda s: s != "")
    fields = F.concat(
        F.array(F.concat(F.lit("source-payload-digest: "), digest(payload)), F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), lang)),
        F.transform(lines, lambda s: F.concat(F.lit("source-header: "), s)),
        F.transform(links, lambda s: F.concat(F.lit("outlink: "), s)),
    )
    # References are resolved in a text without markup that is made once.
    base = once(found, "__open", _unmarked(payload)).select(
        *keep, "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date", headers.alias("source_headers"),
        digest(payload).alias("source_digest"), F.concat(F.array_join(fields, CRLF), F.lit(CRLF)).alias("__meta"), _settled(F.col("__open")).alias("__text"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("__meta").alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__text").alias("block")),
    )
    each = base.withColumn("__r", F.explode(kinds))
    return each.select(
        *keep, "__r.record_type", uuid_of(F.concat_ws(" ", "__r.record_type", "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", "__r.content_type", "__r.block", digest(F.col("__r.block")).alias("block_digest"), "source_digest", "source_headers",
    )


def serialised(records: DataFrame) -> DataFrame:
    """One ``value`` for each derived record: version, headers, blank line and block."""
    lines = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
    ]
    head = [F.concat(F.lit(f"{name}: "), F.col(c), F.lit(CRLF)) for name, c in lines]
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    return records.select(F.concat(F.lit(VERSION + CRLF), *head, length, "block").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Files of records, gzip-compressed, one for each partition, by Spark's own writer."""
    serialised(records).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of such files: headers as a map, the block, and whether its length is the one stated.

    Records are parted at the version line; a block that holds such a line of its own comes back with ``whole`` false.
    """
    rows = spark.read.option("lineSep", VERSION + CRLF).text(path).where("value <> ''")
    cut_at = F.instr("value", CRLF + CRLF)
    head = F.substring("value", F.lit(1), cut_at - 1)
    block = F.regexp_replace(F.expr("substring(value, instr(value, '\r\n\r\n') + 4)"), r"\r\n\r\n\z", "")
    pairs = F.transform(F.split(head, CRLF), lambda s: F.struct(F.substring_index(s, ": ", 1).alias("k"), F.regexp_replace(s, "^[^:]*: ?", "").alias("v")))
    fields = F.map_from_entries(pairs)
    return rows.select(fields.alias("headers"), block.alias("block")).withColumn(
        "whole", F.octet_length("block") == F.col("headers")["Content-Length"].cast("int")
    )
