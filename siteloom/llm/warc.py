"""WARC archives: writing, reading back, and revisit resolution by payload digest.

Records are written with Spark's text sink, whose line separator is the blank
lines that end a record, and read with the binary-file source, so that archives
live wherever Spark reads and writes.  A file is read as one value, so its size is bounded: no
file holds more than FILE_BYTES, but for a single record beyond that.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, as_text

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, warc_type string, page_id long, uri string, date string, digest string, n_bytes long, refers_to long"
_BATCH = 4 << 20
#: The most bytes of records in an archive file, unless one record alone has more.
FILE_BYTES = 256 << 20
#: Files that a writing task holds open before it sorts its records by file.
_OPEN = 32


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by five hex digits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_text(kind: Column, payload: Column, n_bytes: Column, refers: dict[str, Column] | None = None) -> Column:
    """A record with fresh headers, without the separator that ends it.

    ``payload`` (binary) is left out of the block of a revisit record.
    """
    head = F.concat(F.lit(HTTP), n_bytes.cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    length = F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(n_bytes)
    extra = [_field(k, F.when(revisit, v)) for k, v in (refers or {}).items()]
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _field("WARC-Target-URI", F.col("uri")), _field("WARC-Date", F.col("date")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("X-Page-Id", F.col("page_id")), _field("X-Payload-Length", n_bytes), *extra,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        head, F.when(revisit, F.lit("")).otherwise(payload.cast("string")),
    )


def record_bytes(payload: Column, *uris: Column) -> Column:
    """At least the bytes of a record: its payload, its addresses and 1,000 for the other headers."""
    return sum((F.coalesce(F.octet_length(u), F.lit(0)) for u in uris), F.coalesce(payload, F.lit(0)).cast("long") + 1_000)


def _file_of_row(size: Column, file_bytes: int) -> tuple[Column, Column]:
    """The file of a row within its task, without a shuffle: (class of size, stretch of row numbers).

    Class c holds records of at most 4^c / 4096 of a file, and a stretch of 4096 / 4^c row numbers makes a file, so
    that no file has more than ``file_bytes``; records beyond a quarter of a file have one each.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(6), F.ceil(F.log(4.0, size * 4096 / F.lit(file_bytes))))).cast("int")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return level, F.floor(row / F.pow(F.lit(4.0), 6 - level)).cast("long")


def write_records(ws: Workspace, records: DataFrame, path: str) -> None:
    """Write record texts ``value`` as gzip archives, a folder for each pair of the two other columns.

    Records of a task that agree in both make one file.
    """
    folders = [c for c in records.columns if c != "value"]
    with ws.writing(), ws.open_writers(_OPEN):
        records.write.option("compression", "gzip").option("lineSep", END).partitionBy(*folders).text(path)


def write_pages(ws: Workspace, pages: DataFrame, path: str, date: str, file_bytes: int = FILE_BYTES) -> None:
    """One response record per row of ``pages(page_id, url, html)``; null html is an empty payload.

    Repeated rows get a record each.  A null url becomes ``urn:page:<id>``; control
    characters and blanks in urls are dropped.  Files hold at most ``file_bytes`` or one record.
    """
    html = as_text("html")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\x00-\x20\x7F]+", "")
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url").cast("string"), F.monotonically_increasing_id().cast("string")))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    body = F.encode(html, "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), body.alias("payload"), url.alias("uri"), uid.alias("record_id"), F.lit(date).alias("date"), base32_sha1(body).alias("digest"))
    level, stretch = _file_of_row(record_bytes(F.octet_length("payload"), F.col("uri")), file_bytes)
    text = record_text(F.lit("response"), F.col("payload"), F.octet_length("payload").cast("long"))
    write_records(ws, rows.select(text.alias("value"), level.alias("level"), stretch.alias("stretch")), path)


def _unzipped(data: bytes) -> Iterator[bytes]:
    step = 1 << 20
    while data:
        z, at = zlib.decompressobj(31), 0
        while not z.eof and at < len(data):
            if out := z.decompress(data[at : at + step]):
                yield out
            at += step
        data = z.unused_data + data[at:] if z.eof else b""


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    chunks, buf = _unzipped(data), bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while (at := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                return
        lines = bytes(buf[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        n = int(head["Content-Length"])
        if not fill(at + 4 + n):
            raise ValueError("the archive ends within a record")
        yield head, bytes(buf[at + 4 : at + 4 + n])
        fill(at + 8 + n)
        del buf[: at + 8 + n]


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of :data:`HEADERS`, with ``payload`` (binary, null for revisits) if asked for.

    Digest and length of response records come from the payload itself.
    """
    schema = HEADERS + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for h, block in _records(batch.column(0)[i].as_py()):
                    page, refers, kind = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id"), h["WARC-Type"]
                    body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode()
                    row = (h["WARC-Record-ID"][10:-1], kind, page and int(page), h.get("WARC-Target-URI"), h.get("WARC-Date"), digest, int(h["X-Payload-Length"]) if body is None else len(body), refers and int(refers))
                    rows.append((*row, body) if payload else row)
                    held += len(body or b"") * payload + 300
                    if held > _BATCH:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per header row: record_type, and of a revisit the original's page, uri and date.

    Headers only are shuffled, by digest.  The original is the record with the
    smallest page_id (nulls last; then the smallest record_id).  The smallest is
    taken with map-side aggregation and joined back, where a digest with a large
    share of all records is split by the adaptive skew join.  Payloads under
    ``min_bytes`` are all responses.
    """
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "date")
    best = headers.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min(first).alias("o"))
    best = best.select(F.col("digest").alias("d"), F.col("n_bytes").alias("n"), "o")
    joined = headers.join(best, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n")), "left")
    again = F.col("o.record_id").isNotNull() & (F.col("o.record_id") != F.col("record_id"))
    return joined.select(
        *headers.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
        *(F.when(again, F.col(f"o.{c}")).alias(f"o_{c}") for c in ("page_id", "record_id", "uri", "date")),
    )


def with_files(told: DataFrame, size: Column, file_bytes: int) -> DataFrame:
    """Add ``slot`` and ``part``, which name the archive file of each record.

    A slot is what one task of a join by record_id holds (its shuffle partition), so that the join's tasks write whole files;
    within it records of at most half a file are dealt by their running bytes, and larger ones have a file each.
    Headers only are shuffled.
    """
    tasks = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = told.withColumn("_size", size).withColumn("slot", F.pmod(F.hash("record_id"), F.lit(tasks)))
    large, before = F.col("_size") > file_bytes // 2, Window.partitionBy("slot").orderBy("record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = F.when(large, F.lit(0).cast("long")).otherwise(F.col("_size"))
    dealt = F.floor((F.sum(small).over(before) - small) / (file_bytes // 2)).cast("long")
    return rows.withColumn("part", F.when(large, -F.count_if(large).over(before)).otherwise(dealt)).drop("_size")


def deduplicate_archive(ws: Workspace, source: str, target: str, date: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write to ``target`` the archive at ``source`` with repeated payloads as revisit records.

    Payloads move once, to meet the decision on their record; revisit records are
    made from headers alone.  Files hold at most ``file_bytes`` of records, or one record.
    """
    spark = ws.spark
    decided = resolve_revisits(read_records(spark, source, payload=False).drop("refers_to"), min_bytes)
    payload = F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(0)
    told = ws.save(with_files(decided, record_bytes(payload, F.col("uri"), F.col("o_uri")), max(2, file_bytes)), "decisions")
    kept = told.where("record_type = 'response'").select("record_id", "slot", "part")
    whole = read_records(spark, source).select("record_id", "page_id", "uri", "date", "digest", "n_bytes", "payload").join(kept.hint("merge"), "record_id")
    responses = whole.select(record_text(F.lit("response"), F.col("payload"), F.col("n_bytes")).alias("value"), "slot", "part")
    refers = {
        "WARC-Refers-To": F.concat(F.lit("<urn:uuid:"), F.col("o_record_id"), F.lit(">")),
        "WARC-Refers-To-Target-URI": F.col("o_uri"), "WARC-Refers-To-Date": F.col("o_date"),
        "WARC-Profile": F.lit(PROFILE), "X-Refers-To-Page-Id": F.col("o_page_id"),
    }
    again = told.where("record_type = 'revisit'").withColumn("date", F.lit(date))
    revisits = again.select(record_text(F.lit("revisit"), F.lit(b""), F.col("n_bytes"), refers).alias("value"), "slot", "part")
    write_records(ws, responses.unionByName(revisits), target)


def revisit_pages(ws: Workspace, pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", later: str = "2024-01-02T00:00:00Z") -> DataFrame:
    """Write pages, resolve revisits, write the deduplicated archive and read it back.

    Null page ids stay null; an empty table gives no rows; other columns are ignored.
    """
    raw, slim = ws.path("warc"), ws.path("warc-dedup")
    write_pages(ws, pages, raw, date)
    deduplicate_archive(ws, raw, slim, later, min_bytes)
    ws.drop_path(raw)
    return read_records(ws.spark, slim, payload=False)
