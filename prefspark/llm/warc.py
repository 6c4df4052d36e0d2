"""WARC archives of pages, written and read by Spark, with segmented records put together again.

Writing.  A page is a ``response`` record: an HTTP header and its payload in chunked transfer framing.  Of the pages
with equal payloads of at least ``min_revisit`` bytes those of the largest id keep it; the others are ``revisit``
records (HTTP header only) that refer to it.  A block longer than ``segment_bytes`` is cut: the first segment
keeps the record's type, the rest are ``continuation`` records with the origin's identifier, their segment number
and, on the last, the total length.  A record ends with two line ends, so Spark's text writer with that
line separator writes plain WARC files (gzip), ``file_records`` records each, with its own commit.

Reading.  Files are bounded, so each is one value of Spark's binary reader, which also reads stores that only Spark
knows; a task parses it by the records' lengths.  Unsegmented records are decoded where they stand.  Segments
are grouped by origin identifier, ordered by number, checked (numbers 1 to n, sum equal to the stated total)
and joined; then chunked framing is decoded.  A record that fails a check has a null payload and ``complete`` false.

Hot groups: equal payloads meet only as (digest, length) in an aggregate; pages and revisits find their response by
``hot_join.lookup``, so a payload that a third of all pages share is no hot task.

Defined results: null html is an empty payload; a null url is written as ``urn:page:<id>``, blanks and control
characters in it as %20; a null id comes back null and is a response only where no equal payload has an id;
rows that repeat the largest id and its payload are all responses, with one identifier; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .arrays import releasing
from .hot_join import lookup

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT = 1000

_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
           ("refers", pa.string()), ("digest", pa.string())]
_RECORD = pa.schema([*_FIELDS, ("payload", pa.binary()), ("complete", pa.bool_())])
_SEGMENT = pa.schema([*_FIELDS, ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_DDL = "record_id string, record_type string, page_id long, url string, refers string, digest string, "


def record_id(*parts: Column) -> Column:
    """An identifier made of the md5 of ``parts``, so that a retried task writes the same one."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def chunked(body: Column, chunk_bytes: int) -> Column:
    """``body`` (binary) in chunked transfer framing, as a string of the same bytes."""
    n = F.octet_length(body)
    sizes = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))

    def chunk(at: Column) -> Column:
        part = F.substring(body, at + 1, F.lit(chunk_bytes))
        return F.concat(F.lower(F.hex(F.octet_length(part).cast("long"))), F.lit(CRLF), part.cast("string"), F.lit(CRLF))
    return F.concat(F.array_join(F.transform(sizes, chunk), ""), F.lit("0" + END))


def line(name: str, value: Column) -> Column:
    """One header line, or nothing where ``value`` is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment_bytes: int = 8192,
                   chunk_bytes: int = 4096, file_records: int = 2000) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files into the folder ``path``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"))
            .withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long")))
    same = (rows.filter(F.col("size") >= min_revisit).groupBy("digest", "size")
            .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    rows = lookup(rows, same, ["digest", "size"], "rows", F.col("page_id"))
    # a class without any id has a null response_id, as have payloads that stand once: all responses
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    link = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"),
                      F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    head = F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked"]) + END)
    # parts of a record that repeat with the row; pages of one id and payload are one record
    rows = rows.select(
        record_id(F.col("page_id"), F.col("digest"), F.when(revisit, "url")).alias("id"), "page_id", link.alias("url"), "digest",
        F.when(revisit, record_id(F.col("response_id"), F.col("digest"), F.lit(None))).alias("refers"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
        F.when(revisit, head.cast("binary")).otherwise(
            F.concat(head, chunked(F.col("body"), chunk_bytes)).cast("binary")).alias("block"))
    rows = rows.withColumn("length", F.octet_length("block").cast("long"))
    rows = rows.withColumn("parts", F.ceil(F.col("length") / segment_bytes).cast("int"))
    segs = rows.withColumn("seg", F.explode(F.sequence(F.lit(1), "parts")))
    first, many = F.col("seg") == 1, F.col("parts") > 1
    part = F.when(many, F.substring("block", (F.col("seg") - 1) * segment_bytes + 1, F.lit(segment_bytes))).otherwise(F.col("block"))
    segs = segs.withColumn("part", part)
    fields = [
        ("WARC-Type", F.when(first, F.col("type")).otherwise(F.lit("continuation"))),
        ("WARC-Record-ID", F.when(first, F.col("id")).otherwise(record_id(F.col("id"), F.col("seg")))),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("Page-ID", F.col("page_id")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        ("WARC-Profile", F.when(F.col("type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.col("refers")),
        ("WARC-Segment-Number", F.when(many, F.col("seg"))), ("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("seg") == F.col("parts")), F.col("length"))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length("part")),
    ]
    value = F.concat(F.lit("WARC/1.1" + CRLF), *[line(k, v) for k, v in fields], F.lit(CRLF), F.col("part").cast("string"))
    (segs.select(value.alias("value")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


def inflate(data: bytes) -> bytes:
    """The content of a file of any number of gzip members, or the file itself."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        out.append(z.flush())
        data = z.unused_data
    return b"".join(out) if out else data


def parse_records(data: bytes):
    """(fields with lower-case names, block, whole) of each record of an uncompressed file."""
    at, end = 0, len(data)
    while True:
        while data[at: at + 2] == b"\r\n":
            at += 2
        if at >= end:
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[stop + 4: stop + 4 + size]
        yield fields, block, len(block) == size
        at = stop + 4 + size


def decode_chunked(body: bytes) -> bytes | None:
    """The content of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        at = stop + 2 + size
        if size < 0 or body[at: at + 2] != b"\r\n":
            return None
        out.append(body[stop + 2: at])
        at += 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, its transfer framing decoded."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    if fields.get(b"transfer-encoding", b"").strip().endswith(b"chunked"):
        return decode_chunked(body)
    return body


def _head(f: dict) -> tuple:
    page = f.get("page-id")
    return (f.get("warc-record-id"), f.get("warc-type"), int(page) if page else None, f.get("warc-target-uri"),
            f.get("warc-refers-to"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None)


def _batches(rows, schema: pa.Schema, size: int = 1000):
    """Row tuples as record batches."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _payload(kind: str, block: bytes, whole: bool) -> tuple:
    """(payload, complete); a revisit has none of its own."""
    got = http_payload(block) if whole and kind != "revisit" else None
    return got, whole and (kind == "revisit" or got is not None)


def _files(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield from parse_records(inflate(b.column(0)[i].as_py()))


def _whole(batches):
    """Unsegmented response and revisit records, decoded."""
    yield from _batches(((*_head(f), *_payload(f["warc-type"], block, whole)) for f, block, whole in _files(batches)
                         if f.get("warc-type") in ("response", "revisit") and "warc-segment-number" not in f), _RECORD)


def _segments(batches):
    """First segments and continuation records, as they stand."""
    yield from _batches(((*_head(f), f.get("warc-segment-origin-id") or f.get("warc-record-id"), int(f["warc-segment-number"]),
                          int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block if whole else None)
                         for f, block, whole in _files(batches) if "warc-segment-number" in f), _SEGMENT)


def _joined(batches):
    """Reassembled blocks, decoded."""
    for b in batches:
        rows = zip(*[b.column(i).to_pylist() for i in range(b.num_columns)])
        yield from _batches(((*r[:6], *_payload(r[1], r[6] or b"", r[7])) for r in rows), _RECORD)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin identifier: the first segment's fields, the joined block, and whether the numbers are 1 to n and
    the lengths sum up to the stated total.  A segment that stands twice counts once."""
    heads = ["record_id", "record_type", "page_id", "url", "refers", "digest"]
    parts = F.array_sort(F.collect_set(F.struct("segment", "block")))
    got = segments.groupBy("origin").agg(
        parts.alias("parts"), F.max("total").alias("total"),
        F.min_by(F.struct(*heads), F.when(F.col("segment") == 1, 1)).alias("head"),
        # pages that repeat as a whole wrote their first segment as often
        F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("times"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["block"]).cast("long"))
    whole = (F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))) & (size == F.col("total"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    return (got.filter("times > 0")
            .select(*[F.col(f"head.{h}").alias(h) for h in heads], block.alias("block"),
                    F.coalesce(whole, F.lit(False)).alias("whole"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("_t"))
            .drop("_t"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, url, refers, digest, payload, complete) of the archives in ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(releasing(_whole), _DDL + "payload binary, complete boolean")
    parts = files.mapInArrow(releasing(_segments), _DDL + "origin string, segment int, total long, block binary")
    return whole.unionByName(reassemble(parts).mapInArrow(releasing(_joined), _DDL + "payload binary, complete boolean"))


def summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with the length, digest
    and id of the response they refer to.  Null length and digest mark a record that is not complete."""
    spark = records.sparkSession
    path = scratch_table_path(spark, f"warc-summary-{uuid.uuid4().hex}")
    (records.select("record_id", "page_id", "record_type", "refers", F.octet_length("payload").cast("long").alias("payload_bytes"),
                    F.sha1("payload").alias("payload_digest"), "digest")
     .write.mode("overwrite").parquet(path))
    rows = spark.read.parquet(path)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = rows.filter("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "record_type", F.col("refers").alias("id"))
    wanted = revisits.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    known = (rows.filter("record_type = 'response'")
             .select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
             .join(wanted, "id").dropDuplicates(["id"]))
    return responses.unionByName(
        lookup(revisits, known, ["id"], "rows", F.col("page_id")).select(*out, "refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write, then read back."""
    spark = pages.sparkSession
    path = path or scratch_table_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **kw)
    return summary(read_records(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""
