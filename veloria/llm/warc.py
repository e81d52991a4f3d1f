"""WARC archives of crawled pages: one gzip member per record, and a reader that splits the files by byte ranges.

Writing. Spark's committing text writer puts the members down as they are. It ends each row with the line separator, which
is set to one zero byte here: a gzip member ends with the size of its content, whose upper byte is zero below 16 MB, so
that byte is left to the writer. After a larger record stands an empty member, whose last byte is zero as well.

Reading. A task has a byte range of a file. It looks for gzip magic in it, decodes the start of each candidate and takes it
as a member if a WARC header comes out. It owns the records that start in its range and reads past the end for the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path
from .tokens import small_batches

LEAST_PAYLOAD = 0
RANGE_BYTES = 8 << 20
CHUNK = 1 << 20
HOT_KEYS = 20_000
#: Ranges are dealt to at most so many tasks at once.
MOST_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit keeps the response's headers, its payload's length and digest, not its payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        body += payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}"] if target is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, least: int = LEAST_PAYLOAD, hot_keys: int = HOT_KEYS) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: of equal payloads of at least ``least`` bytes, all but the smallest page_id revisit it.

    Null html is the empty payload. A null page_id never is the one referred to unless no other has the payload; rows that
    repeat the smallest page_id are responses all. Only digests and ids are grouped, combined on the map side. Payloads of
    more than one in ``hot_keys`` rows number fewer than ``hot_keys``, so they go to every executor and their pages are not
    brought together; the others are met in a merge join, where no payload has many rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_key", F.unhex(F.sha2("payload", 256)))
    shared = rows.where(F.length("payload") >= least).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = materialise(shared, "shared-payloads")
    is_hot = F.col("_n") * F.lit(hot_keys) > F.lit(pages.count())
    hot = shared.where(is_hot).select("_key", F.col("_first").alias("_hot_first"), F.lit(True).alias("_hot"))
    rows = rows.join(hot.hint("broadcast"), "_key", "left")
    # a hot payload's pages are dealt out by themselves and meet nothing
    own = F.unhex(F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), "url", F.spark_partition_id().cast("string")).cast("binary"), 256))
    rows = rows.withColumn("_to", F.when(F.col("_hot"), own).otherwise(F.col("_key")))
    rows = rows.join(shared.where(~is_hot).select(F.col("_key").alias("_to"), F.col("_first").alias("_cool_first")).hint("merge"), "_to", "left")
    first = F.coalesce("_hot_first", "_cool_first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return rows.select("page_id", "url", "payload", F.when(revisit, first).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) under ``path``; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 4 << 20):
            out = []
            for page, url, payload, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = warc_record(page, url, payload, refers, revisit)
                out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
            yield pa.record_batch({"member": pa.array(out, pa.binary())})

    with_revisits(pages, least).mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


def parse_record(data: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record; None if it isn't whole."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return number("warc-record-id"), length, stated, "revisit", number("warc-refers-to"), fields.get("warc-target-uri"), None
    if stated and stated != digest_of(payload):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return number("warc-record-id"), len(payload), digest_of(payload), fields["warc-type"], None, fields.get("warc-target-uri"), payload


def records_in(read, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records (decoded) of the gzip members that start in [start, end) of a file; ``read(at, n)`` gives its bytes.

    A member that was read says where the next one starts; only where no member is known does the search for magic run, so
    magic bytes within a member's compressed data are met at a range's start alone, where decoding refuses them.
    """
    at = start
    while at < end:
        window = read(at, min(CHUNK, end - at + len(MAGIC) - 1))
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(window) - len(MAGIC) + 1)
            if len(window) < len(MAGIC):
                return
            continue
        at += hit
        while at < end:
            decoded = _member(read, size, at)
            if decoded is None:
                at += 1
                break
            data, at = decoded
            if data:
                yield data
            if read(at, len(MAGIC)) != MAGIC:
                break


def _member(read, size: int, at: int) -> tuple[bytes, int] | None:
    """(content, where it ends) of the gzip member at ``at``; None if there is none, or none of a WARC record or empty."""
    z, parts, checked, seen = zlib.decompressobj(31), [], False, 0
    place = at
    while not z.eof:
        chunk = read(place, 1 << 16)
        if not chunk:
            return None
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        seen += len(parts[-1])
        place += len(chunk)
        if not checked and (seen >= 7 or z.eof):
            start = b"".join(parts)[:7]
            if start and start != b"WARC/1.":
                return None
            checked = True
    return b"".join(parts), place - len(z.unused_data)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives under ``path``, by byte ranges of ``range_bytes``.

    Files are listed by Spark without their content; the ranges are dealt out to as many tasks (their number is given, as
    adaptive execution would put such small rows into one), and each task opens its file with pyarrow's file systems (local
    and mounted folders, HDFS, S3 and others by URI).
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 1).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = materialise(files.select("path", "length", starts.alias("start")), "warc-ranges")
    ranges = ranges.repartition(max(1, min(MOST_TASKS, 2 * ranges.count())), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for where, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", where))
                with store.open_input_file(name) as f:
                    held, total = [], 0
                    for data in records_in(lambda a, n: f.read_at(n, a) if a < size else b"", size, start, min(size, start + range_bytes)):
                        if (row := parse_record(data)) is not None:
                            held.append(row)
                            total += len(data)
                        if total > 8 << 20:
                            yield _table(held)
                            held, total = [], 0
                    if held:
                        yield _table(held)

    return ranges.mapInArrow(run, ROWS)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(payload) AS x, page_id IS DISTINCT FROM first AND first IS NOT NULL AS revisit FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM h
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).drop("url", "payload")
