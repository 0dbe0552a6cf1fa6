"""WARC archives and transaction assembly (op7).

Each page becomes a transaction of three records: a request, a response (or a
revisit, when an equal payload of at least ``min_bytes`` bytes is held by a page
of smaller id) and a metadata record.  Request and metadata name the response in
``WARC-Concurrent-To``.  The archives are gzip files in the shared folder, written
by Spark's text sink: a record is one row, and the sink's line separator is the
record's last line feed.  Reading goes by ``Content-Length``, so a payload may hold
anything, and unzips record by record; each archive is read once, its records are
stored and then joined through their concurrent-to identifiers to one nested row a
capture.

Null html is an empty payload.  A null or odd url stands as it is in the metadata
record's JSON block; the target header holds it with blanks and control signs
percent-encoded.  Rows with one page_id are captures of their own; of equal
payloads all rows with the smallest id are responses; a payload that only null
ids hold is a response each time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.store import shared_dir, stored

#: Bounds of a file: its records, and their bytes by the mean of all pages, before they are zipped.
RECORDS_PER_FILE, BYTES_PER_FILE = 30_000, 256 << 20
#: Payload bytes that a task hands on at once.
BATCH_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller id holds.
    Counts and smallest ids are pre-aggregated; only ids and digests move."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", F.sha2(payload, 256).alias("digest"))
    first = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("ids"))
    first = first.filter("refers_to < last OR ids < n AND refers_to IS NOT NULL").select("digest", "refers_to")
    return own.join(first, "digest").filter("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without its last line feed.  A null header is left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``value``: three records a page."""
    seen = stored(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    own = own.join(seen, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    name = lambda kind: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", F.col("row").cast("string"))),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    host, path = F.regexp_extract(uri, r"^[a-z]+://([^/]*)", 1), F.regexp_replace(uri, r"^[a-z]+://[^/]*", "")
    date = ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    main, target = name("response"), ("WARC-Target-URI", uri)
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    again = F.col("refers_to").isNotNull()
    response = _record(F.when(again, "revisit").otherwise("response"), main,
                       [date, target, digest, ("WARC-Profile", F.when(again, F.lit(_PROFILE))),
                        ("WARC-Refers-To-Page", F.when(again, F.col("refers_to").cast("string")))],
                       "application/http;msgtype=response", F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html"))))
    request = _record(F.lit("request"), name("request"), [date, target, ("WARC-Concurrent-To", main)], "application/http;msgtype=request",
                      F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    meta = _record(F.lit("metadata"), name("metadata"), [date, target, ("WARC-Concurrent-To", main)], "application/json",
                   F.to_json(F.struct("page_id", "url")))
    return own.select(F.explode(F.array(request, response, meta)).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    size = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0  # one value
    at_most = max(3, min(RECORDS_PER_FILE, int(3 * BYTES_PER_FILE / (size + 2000))))  # a page is three records of some 700 bytes beside it
    records(pages, min_bytes).write.option("lineSep", "\n").option("maxRecordsPerFile", at_most).text(path, compression="gzip")


_FIELDS = [("record_id", pa.string()), ("concurrent_to", pa.string()), ("type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()),
           ("stated_digest", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string()), ("block", pa.string())]
_SCHEMA = ("record_id string, concurrent_to string, type string, target string, refers_to string, stated_digest string, digest string, "
           "payload_bytes long, payload string, block string")


def _headers(file: BinaryIO) -> dict[str, str]:
    out = {}
    while (line := file.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().removesuffix("\r\n").partition(": ")
        out[name] = value
    return out


def parse(file: BinaryIO) -> Iterator[tuple]:
    """The records of an unzipped archive, in order; one is held at a time."""
    while version := file.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        h = _headers(file)
        block = file.read(int(h["Content-Length"]))
        if len(block) < int(h["Content-Length"]) or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {h['WARC-Record-ID']} is cut off")
        digest = size = payload = None
        if h["WARC-Type"] in ("response", "revisit"):
            head, _, data = block.partition(b"\r\n\r\n")
            size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
            if h["WARC-Type"] == "response":
                digest = hashlib.sha256(data).hexdigest()
                if len(data) != size or f"sha256:{digest}" != h["WARC-Payload-Digest"]:
                    raise ValueError(f"record {h['WARC-Record-ID']}: payload and digest differ")
            payload, block = data.decode(), None
        yield (h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h["WARC-Type"], h.get("WARC-Target-URI"), h.get("WARC-Refers-To-Page"),
               h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, digest, size, payload, None if block is None else block.decode())


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ``payload`` of a response or revisit, ``block`` of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                held = 0
                for r in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(r)
                    held += len(r[8] or "")
                    if len(rows) == 2000 or held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def captures(rows: DataFrame) -> DataFrame:
    """One nested row a capture: ``page_id``, ``url`` and the structs ``request``,
    ``response`` (payload in ``block``; none in a revisit) and ``metadata``."""
    main = rows.filter(F.col("type").isin("response", "revisit")).select("record_id", F.struct(
        *[c for c, _ in _FIELDS if c not in ("concurrent_to", "payload", "block")], F.col("payload").alias("block")).alias("response"))
    side = lambda kind: rows.filter(F.col("type") == kind).select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target", "block").alias(kind))
    page = F.from_json("metadata.block", "page_id long, url string")
    return (main.join(side("request"), "record_id").join(side("metadata"), "record_id")
            .select(page.alias("page"), "request", "response", "metadata").select("page.page_id", "page.url", "request", "response", "metadata"))


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and assembles them again."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return captures(stored(read(spark, path), "warc-records"))
