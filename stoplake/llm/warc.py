"""WARC archives with revisit resolution (operator 10).

Only headers (page_id, digest, size) are shuffled to find equal payloads: each digest's largest page_id
is its response, counted before the shuffle as far as possible, so that a payload with a third of all
pages is one row for each task. Digests that occur once never meet the join. The decisions then join the
pages by digest, where Spark splits an overlong partition; a revisit keeps the headers alone.

A record is one line of Spark's text writer whose line end is the blank lines that end a WARC record, so
archives are written by the JVM through any Hadoop file system, compressed with gzip. They are read record by
record, by content length, and payloads are held against their digests.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.llm.common import BATCH_BYTES, prepare, scratch

#: Shorter payloads are always stored.
LEAST_BYTES = 1000
#: Records of an archive at most: a reader holds an archive's compressed bytes and one record.
FILE_RECORDS = 4000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def decide(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, payload_bytes and refers_to (null: a response).

    A null html is an empty payload. Of rows that repeat the largest page_id of a payload each is a
    response; rows with a null page_id refer to the largest one, and are responses if there is none.
    Other columns of pages are left out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    headers = pages.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = headers.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = first.withColumnRenamed("payload_digest", "digest")
    joined = pages.join(first, pages.payload_digest == first.digest, "left")
    refers = F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write(decided: DataFrame, path: str) -> None:
    """Archives under path: one record for each row, revisits without their payload."""
    crlf = "\r\n"
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = [
        F.concat(F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit(f"WARC-Record-ID: <{ID}"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(again, F.concat(F.lit(f"WARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(f">{crlf}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(crlf, *head), F.lit(crlf + crlf), block)
    decided.select(record.alias("value")).write.option("lineSep", crlf * 2).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of an open archive, of which one record at a time is held."""
    while first := archive.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record before byte {archive.tell()}")
        head = {}
        while (line := archive.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("an archive ends within a header")
            name, _, value = line[:-2].decode().partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        block = archive.read(size)
        if len(block) != size or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record before byte {archive.tell()} does not end there")
        yield head, block


def row_of(head: dict[str, str], block: bytes, payload: bool) -> list:
    """A row of FIELDS; a response whose payload is not what its headers say raises ValueError."""
    http, _, body = block.partition(b"\r\n\r\n")
    size, digest, again = int(http.rsplit(b"Content-Length: ", 1)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    if not again and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its headers say")
    ids = [None if x in (None, "none") else int(x) for x in (_page(head.get(k)) for k in ("WARC-Record-ID", "WARC-Refers-To"))]
    row = [ids[0], head["WARC-Target-URI"], size, digest, head["WARC-Type"], ids[1]]
    return [*row, None if again else body.decode()] if payload else row


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row for each record of the archives under path; with payload, also html (null for revisits).

    payload_bytes of a revisit is what its stored HTTP headers say of the payload that it stands for. Records are read
    one by one, and the payload of each response is held against its length and digest; what does not fit is an error.
    """
    prepare(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, held = [], 0
                # decompressed as it is read
                with io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw.as_buffer())), 1 << 16) as archive:
                    for head, block in records(archive):
                        rows.append(row_of(head, block, payload))
                        held += len(block) if payload else 0
                        if len(rows) == 256 or held > BATCH_BYTES:
                            yield _batch(rows, payload)
                            rows, held = [], 0
                yield _batch(rows, payload)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, FIELDS + ", html string" * payload)


def _page(uri: str | None) -> str | None:
    return uri and uri.removeprefix(f"<{ID}").removesuffix(">")


def _batch(rows: list[list], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * payload]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * payload]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def resolved(archive: DataFrame) -> DataFrame:
    """What read(payload=True) gives, each revisit with the html of the response that it refers to."""
    origin = archive.filter("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("html").alias("_html")).dropDuplicates(["_id", "_digest"])
    joined = archive.join(origin, (archive.refers_to == origin._id) & (archive.payload_digest == origin._digest), "left")
    return joined.withColumn("html", F.coalesce("html", "_html")).drop("_id", "_digest", "_html")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write deduplicated archives of pages to the shared folder and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write(decide(pages), path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: DuckDB SQL for archive_round_trip().
ORACLE = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), w AS (
  SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN w.response_id IS NOT NULL AND p.page_id IS DISTINCT FROM w.response_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM w.response_id THEN w.response_id END AS refers_to,
  regexp_replace(coalesce(p.url, ''), '[\\r\\n]+', '%0A', 'g') AS url
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes >= 1000
"""
