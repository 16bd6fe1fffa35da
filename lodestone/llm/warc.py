"""WARC writing with revisit resolution.

Headers (no payloads) are shuffled by payload digest; the record with the smallest page id of each
digest is the response, the others revisit it. The decisions that are not "response" form a table
of their own, which is joined back to the pages as they are written, and the archives get fresh
headers. Records are built by Spark expressions, gathered to chunks and written by Spark's text sink:
every record ends in a line feed, and the sink puts that of a chunk's last one there, so the files are
WARC/1.1 byte for byte (gzip around the whole file) and of a bounded number of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import blocks, text_buffer
from lodestone.scratch import materialize, scratch_path

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"
_ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 SHA-1 of a binary column, by ten hex digits (40 bits) at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Revisits only: page_id, payload_digest, sha256, refers_to.

    Payloads are equal if their length, SHA-1 and SHA-256 are. Only headers are shuffled, and the
    originals are aggregated map-side first, so one payload may hold any share of the rows. Pages
    that repeat the smallest id of their payload are responses too; null ids are never originals,
    and responses where a payload has no other."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    headers = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("payload_digest"), F.sha2(payload, 256).alias("sha256")
    ).filter(F.col("bytes") >= min_bytes)
    headers = materialize(headers, "warc-headers")
    keys = ["payload_digest", "sha256", "bytes"]
    originals = headers.groupBy(*keys).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = headers.join(originals, keys).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return materialize(revisits.select("page_id", "payload_digest", "sha256", "refers_to").distinct(), "warc-revisits")


def records(pages: DataFrame, revisits: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A `value` per page: its WARC record but for the last line feed."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"), F.sha2(payload, 256).alias("sha256"),
    )
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("sha256").alias("r_sha256"), "refers_to", F.lit(True).alias("revisit"))
    both = p.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("sha256") == F.col("r_sha256")), "left")
    again = F.coalesce("revisit", F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return both.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def _gather(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            for a, b in blocks(offs, chunk_bytes):
                rows = (buf[i:j].tobytes() for i, j in zip(offs[a:b].tolist(), offs[a + 1 : b + 1].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(rows)], pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = 4 << 20, chunks_per_file: int = 16) -> str:
    """Write deduplicated archives of `pages` (page_id, url, html; other columns are ignored) under
    `path` and return it. Null html is an empty payload, null url an empty target. A file holds at most
    `chunks_per_file` chunks, and a chunk about `chunk_bytes` bytes, or one record that is larger."""
    chunks = map_in_arrow(records(pages, resolve(pages, min_bytes)), _gather(chunk_bytes), "value binary")
    chunks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", chunks_per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(uri: str | None) -> int | None:
    found = uri.removeprefix(f"<{_ID}").removesuffix(">") if uri else "null"
    return None if found == "null" else int(found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse(zlib.decompress(content.as_buffer(), 31)):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2]
                whole = kind == "revisit" or (base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == int(head["WARC-X-Payload-Length"]))
                rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["WARC-X-Payload-Length"]), digest, kind, _page(head.get("WARC-Refers-To")), whole))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`RECORDS` of the archives under `path`, a row a record; `payload_ok` says whether a
    response's payload has the digest and length that its header claims."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return map_in_arrow(files.select("content"), _read, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of `pages` written to the shared folder and read back. An empty table writes no
    record and gives no rows."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, scratch_path(spark, "warc"), min_bytes))
