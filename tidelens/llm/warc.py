"""WARC archives: a writer with revisit records, and a salvage reader.

The writer is Spark's text writer: a record is a row, and the line separator is the two line ends that close a record, so
every part file is a plain WARC file and the job survives lost executors through Spark's own commit protocol.

The reader takes plain archives and archives of gzip members. It checks each record (version line, headers, length, end
mark, payload digest). After a failed check it searches for the next place where a whole valid record stands, goes on
there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm.common import scratch_path, written

CRLF, END = "\r\n", "\r\n\r\n"
MIN_REVISIT = 100  # bytes: smaller payloads are always stored
BROADCAST_ROWS = 100_000  # repeated payloads' ids up to this many rows are broadcast, beyond it they are joined by a shuffle
#: Payload bytes from which a page is of a class, and records that a file of the class holds at most.
FILES = ((0, 1024), (256 << 10, 32), (8 << 20, 1))
PIECE = 64 << 10  # bytes of a gzip member that are decompressed at once

# ---- writing ------------------------------------------------------------------------------------------------------


def _sent(url: Column) -> Column:
    """The URL as a header can hold it: line ends become spaces, outer white space goes."""
    return F.regexp_replace(F.regexp_replace(url.cast("string"), r"[\r\n]+", " "), r"^[\s\x00]+|[\s\x00]+$", "")


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends in the value become spaces."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(CRLF))).otherwise(F.lit(""))


def classify(pages: DataFrame, key: str, payload: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least min_bytes the one with the smallest key is the response and the others revisit it.
    Rows that repeat a key with its payload: all are responses where the key is the smallest. A null payload is empty;
    a null key is smaller than none, and a payload that only null keys hold is stored each time.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    full = pages.withColumn(payload, body).withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha2(F.encode(F.col(payload), "UTF-8"), 256))
    slim = full.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", F.col(key).alias("_key"))
    # A hot payload is pre-aggregated before the shuffle; only payloads that repeat go on.
    repeated = slim.groupBy(F.col("payload_digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min("_key").alias("_first")).filter("_n > 1 AND _first IS NOT NULL").drop("_n")
    repeated = written(repeated, "repeated")
    small = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = full.join(F.broadcast(repeated) if small else repeated, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col(key).eqNullSafe(F.col("_first"))
    return (
        joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_digest", "_first")
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row as WARC files under path: response records with the payload, revisit records without.

    Pages of a size class (FILES) have files of their own, so a file stays small enough to be read at once, unless one
    payload alone is larger. A URL that a header can't hold as it is stands in X-Target-URI too, in base64. Nulls, ties
    and repeated rows are as in classify; an empty table writes an archive without records.
    """
    rows = classify(pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.col(payload).alias("_html")), "_id", "_html")
    stored = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(stored, F.col("_html")).otherwise(F.lit("")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(">"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _sent(F.col("_url"))),
        _field("X-Target-URI", F.when(~F.col("_url").cast("string").eqNullSafe(_sent(F.col("_url"))), F.base64(F.encode(F.col("_url").cast("string"), "UTF-8")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _field("X-Payload-Length", F.col("payload_bytes")),
        _field("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(F.col("_block"))),
        F.lit(CRLF),
        F.col("_block"),
    )
    records = rows.withColumn("_block", block)
    ends = [least for least, _ in FILES[1:]] + [None]
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    there = pages.agg(*[F.max((size >= least) if end is None else (size >= least) & (size < end)).alias(f"c{k}") for k, ((least, _), end) in enumerate(zip(FILES, ends, strict=True))]).first()
    for k, ((least, per_file), end) in enumerate(zip(FILES, ends, strict=True)):
        if there[k] or k == 0:
            of = F.col("payload_bytes") >= least
            own = records.filter(of if end is None else of & (F.col("payload_bytes") < end))
            own.select(record.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(f"{path}/class{k}")


# ---- reading ------------------------------------------------------------------------------------------------------


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]  # names in lower case; a repeated name keeps its first value
    payload: bytes  # of an HTTP block the part after its own headers


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    pass


_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_BLANK, _BLANK_LF = re.compile(rb"\r\n\r\n"), re.compile(rb"\n\n")
_START = re.compile(rb"WARC/\d+\.\d+\r?\n|\x1f\x8b\x08")


def _parse(data: bytes | memoryview, at: int) -> tuple[Record, int]:
    """The record at a place and the place after it; Damaged if a check fails."""
    if not (m := _VERSION.match(data, at)):
        raise Damaged("no version line")
    eol = b"\r\n" if m[0].endswith(b"\r\n") else b"\n"
    if not (close := (_BLANK if eol == b"\r\n" else _BLANK_LF).search(data, m.end() - len(eol))):
        raise Damaged("headers have no end")
    stop = close.start()
    headers: dict[str, str] = {}
    for line in bytes(data[m.end() : stop]).split(eol) if stop > m.end() else []:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("a header line has no name")
        headers.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    start, size = stop + 2 * len(eol), int(headers["content-length"])
    end = start + size
    if end > len(data):
        raise Damaged("the block is cut off")
    if data[end : end + 2 * len(eol)] != eol * 2:
        raise Damaged("no end mark")
    block = bytes(data[start:end])
    payload = block
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        payload = block.partition(END.encode())[2]
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        if name == "warc-payload-digest" and headers.get("warc-type") == "revisit":
            continue
        kind, _, digest = headers.get(name, "").partition(":")
        if kind.lower() == "sha256" and hashlib.sha256(content).hexdigest() != digest.lower():
            raise Damaged(f"{name} differs")
    return Record(at, end + 2 * len(eol) - at, headers, payload), end + 2 * len(eol)


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place holds, the place where its bytes end, and what is wrong with it, if anything.

    It is decompressed piece by piece, so the content before a damaged or missing part is not lost.
    """
    unzip, parts, i = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not unzip.eof:
        if i >= len(data):
            return b"".join(parts), len(data), "the member is cut off"
        try:
            parts.append(unzip.decompress(view[i : i + PIECE]))
        except zlib.error as e:
            # What the failing piece holds before the damage comes out byte by byte.
            again = zlib.decompressobj(31)
            content = bytearray()
            try:
                for k in range(at, i, PIECE):
                    content += again.decompress(view[k : min(k + PIECE, i)])
                for k in range(i, min(i + PIECE, len(data))):
                    content += again.decompress(view[k : k + 1])
            except zlib.error:
                pass
            return bytes(content), min(i + PIECE, len(data)), f"bad member: {e}"
        i += PIECE
    return b"".join(parts), min(i, len(data)) - len(unzip.unused_data), ""


def _proved(record: Record) -> bool:
    """Whether a digest of its own vouches for what the record holds."""
    payload = record.headers.get("warc-payload-digest", "") if record.headers.get("warc-type") != "revisit" else ""
    return any(x.lower().startswith("sha256:") for x in (payload, record.headers.get("warc-block-digest", "")))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record of an archive in order, and the gaps between them.

    An empty archive gives nothing. A record that fails a check is in a gap, which runs up to the next valid record or to
    the end of the archive; its reason is that of the first failure. A version line inside a valid record's block is
    content, as the search starts only after a failure; inside a damaged record it starts a record only if all checks
    hold there. A gzip member's content is searched the same way, up to where it can be decompressed: its records have
    the member's place and length in the archive, and a gap inside it is logged as one with the member's place. From a
    member that is cut off or fails its own check, records come only if a digest of theirs holds.
    """
    at, gap, reason = 0, -1, ""
    while at < len(data):
        if data.startswith(b"\x1f\x8b\x08", at):
            content, end, wrong = _member(data, at)
            found = list(_plain(content))
            records = [x for x in found if isinstance(x, Record) and (not wrong or _proved(x))]
            if records or not wrong and not found:
                if gap >= 0:
                    yield Gap(gap, at - gap, reason)
                    gap = -1
                yield from (x._replace(offset=at, length=end - at) for x in records)
                inner = next((x.reason for x in found if isinstance(x, Gap)), "")
                if not wrong:
                    if inner:
                        yield Gap(at, end - at, f"inside the member: {inner}")
                    at = end
                    continue
                gap, reason = at, wrong
            elif gap < 0:
                gap, reason = at, wrong or found[0].reason
        else:
            try:
                record, after = _parse(data, at)
            except Damaged as e:
                if gap < 0:
                    gap, reason = at, str(e)
            else:
                if gap >= 0:
                    yield Gap(gap, at - gap, reason)
                    gap = -1
                yield record
                at = after
                continue
        found_ = _START.search(data, at + 1)
        at = found_.start() if found_ else len(data)
    if gap >= 0:
        yield Gap(gap, len(data) - gap, reason)


def _plain(data: bytes) -> Iterator[Record | Gap]:
    """salvage of content that is not compressed."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            record, after = _parse(data, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            found = _LINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap >= 0:
            yield Gap(gap, at - gap, reason)
            gap = -1
        yield record
        at = after
    if gap >= 0:
        yield Gap(gap, len(data) - gap, reason)


_SCHEMA = "file string, offset long, length long, reason string, headers map<string,string>, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each valid record, and a row with a reason for each quarantined gap, of all archives under path.

    Archives are read whole, one at a time in each task: a file must fit in a task's memory (see write_archives).
    payload_bytes counts what stands in the record. Without payloads that column is null, and the bytes stay in the
    Python worker.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
        names = ["file", "offset", "length", "reason", "headers", "payload_bytes", "payload"]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    gap = isinstance(x, Gap)
                    rows.append((name.as_py(), x.offset, x.length, x.reason if gap else None, None if gap else list(x.headers.items()), None if gap else len(x.payload), x.payload if payloads and not gap else None))
                    size += 0 if gap or not payloads else len(x.payload)
                    if size > 1 << 24 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, _SCHEMA)


def page_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1), F.lit(""))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What the archives of pages say of each page, read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    h = F.col("headers")
    kind = dict(pages.dtypes)["page_id"]
    # The writer's archives have no gaps: one that appears is a lost record, and an error.
    whole = F.coalesce(h["warc-type"], F.raise_error(F.concat(F.lit("a gap in "), F.col("file"), F.lit(": "), F.col("reason"))))
    revisit = F.col("record_type") == "revisit"
    return read_archives(spark, path, payloads=False).withColumn("record_type", whole).select(
        page_of(h["warc-record-id"]).cast(kind).alias("page_id"),
        F.coalesce(F.decode(F.unbase64(h["x-target-uri"]), "UTF-8"), h["warc-target-uri"]).alias("url"),
        F.when(revisit, h["x-payload-length"].cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.substring(h["warc-payload-digest"], 8, 64).alias("payload_digest"),
        "record_type",
        page_of(h["warc-refers-to"]).cast(kind).alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {MIN_REVISIT}
"""
