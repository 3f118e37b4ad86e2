"""A content-addressed WARC archive.

Rows become WARC/1.1 records in gzip files that Spark's own text writer makes: CRLF CRLF, the end of a WARC record, is
the line separator, so the archive can lie in any store Spark writes to. Of rows with equal payloads (by SHA-256) that
with the largest id is a response, the others are revisits without payload. Read back, the archive falls into exact
headers and payloads, each payload once under its SHA-256, which the reader verifies; a join of the two gives the
records of all rows again, with full payloads, and their bytes are held against the archive's.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, key_filter, split_by_filter

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: About so many bytes of records go to one file, whatever their sizes, as a reader takes a whole file into memory.
FILE_BYTES, MOST_RECORDS = 64_000_000, 10_000
PARSED = "id bigint, record_type string, refers_to bigint, payload_digest string, sha256 string, header binary, payload binary, verified boolean, record_sha1 string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, in built-in functions: 40 hex digits are 8 times 20 bits, each 4 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:x-row:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def tag_duplicates(rows: DataFrame, min_bytes: int) -> DataFrame:
    """rows with _refers: the response's id where a row revisits it, else null.

    Only ids and digests are shuffled for all rows. The payloads of digests that come up once stay where they are; a
    filter of bounded size picks the others, and those are joined with their response.
    """
    best = rows.groupBy("_sha256").agg(F.max("_id").alias("_best"), F.max("_bytes").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    best = best.where((F.col("_rows") > 1) & (F.col("_n") >= min_bytes) & F.col("_best").isNotNull()).select(F.col("_sha256").alias("_twice"), "_best")
    some, once = split_by_filter(rows, "_sha256", key_filter(best, "_twice"))
    some = some.join(best, F.col("_sha256") == F.col("_twice"), "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_best")), F.col("_best"))
    return some.select(*rows.columns, refers.alias("_refers")).unionAll(once.withColumn("_refers", F.lit(None).cast("bigint")))


def encoded_url(url: Column) -> Column:
    """White space, control characters and the percent sign as percent escapes; replacing those by their bytes gives the url back."""
    url = F.regexp_replace(url, "%", "%25")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archive(
    rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> None:
    """Write a record for each row. A null payload is empty, a null id or url is written as 'null' or left out.

    Equal payloads under min_bytes bytes are all responses. Where rows share a payload and the largest id, each of those is
    a response; rows that share an id but not the payload are records of their own. No rows give an archive without
    records. A record larger than FILE_BYTES has a file of its own. White space, control characters and percent signs in a
    url are percent-encoded, as a header needs.
    """
    data = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).cast("string").alias("_url"), data.alias("_data"))
    rows = rows.withColumns({"_sha256": F.sha2("_data", 256), "_bytes": F.octet_length("_data").cast("bigint")})
    per_file = records_per_file(rows)
    rows = tag_duplicates(rows, min_bytes)
    again = F.col("_refers").isNotNull()
    http = F.concat(F.lit(HTTP + "Content-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("_bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), encoded_url(F.col("_url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("_data")),
        F.lit("\r\nX-Payload-Sha256: "), F.col("_sha256"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("_refers")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
        http, F.when(again, "").otherwise(F.col("_data")),
    )
    out = rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", per_file).text(path)


def records_per_file(rows: DataFrame) -> int:
    """So many records that a file has about FILE_BYTES at the mean size, and FILE_BYTES at most where sizes are alike."""
    mean, most = rows.agg(F.avg("_bytes"), F.max("_bytes")).first()
    return max(1, min(MOST_RECORDS, int(FILE_BYTES / (1000 + max(mean or 0, (most or 0) / 8)))))


def _header(stream: BinaryIO) -> bytes:
    """The lines up to an empty one, which is part of it; nothing at the end of the stream."""
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b""):
        lines.append(line)
    return b"".join([*lines, line])


def parse_records(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header with the HTTP header, payload) of each record, by Content-Length; one record is in memory at a time."""
    while head := _header(stream):
        size = int(_field(head, b"Content-Length"))
        block = stream.read(size)
        if len(block) != size or stream.read(4) != END.encode():
            raise ValueError("a WARC record doesn't end where its Content-Length says")
        body = block.index(END.encode()) + 4
        yield head + block[:body], block[body:]


def _field(head: bytes, name: bytes) -> str | None:
    at = head.find(b"\r\n" + name + b": ")
    return None if at < 0 else head[at + len(name) + 4 : head.index(b"\r\n", at + 2)].decode()


def _row_id(urn: str | None) -> int | None:
    value = (urn or "").rpartition(":")[2].rstrip(">")
    return int(value) if value not in ("", "null") else None


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Each record: id, type, refers_to, digests, exact header bytes and payload (null for revisits, or if not wanted).

    Both digests of a response are computed anew from the payload; verified says whether they hold. record_sha1 is of the
    record's bytes as archived.
    """
    schema = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("sha256", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("verified", pa.bool_()), ("record_sha1", pa.string())])

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file = gzip.GzipFile(fileobj=io.BytesIO(batch.column(0)[i].as_py()))
                out, held = arrow_rows(schema, 500), 0
                for head, body in parse_records(io.BufferedReader(file, 1 << 20)):
                    sha1, sha256, kind = _field(head, b"WARC-Payload-Digest"), _field(head, b"X-Payload-Sha256"), _field(head, b"WARC-Type")
                    own = kind == "response"
                    good = hashlib.sha256(body).hexdigest() == sha256 and "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == sha1 if own else None
                    whole = hashlib.sha1(head + body + END.encode()).hexdigest()
                    yield from out.add(_row_id(_field(head, b"WARC-Record-ID")), kind, _row_id(_field(head, b"WARC-Refers-To")), sha1[5:], sha256, head, body if own and payloads else None, good, whole)
                    held += len(body)
                    if held > 4_000_000:
                        yield from out.flush()
                        held = 0
                yield from out.flush()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, PARSED)


def payload_store(records: DataFrame) -> DataFrame:
    """Each payload once: sha256, payload. A payload whose digest does not hold raises."""
    checked = records.where("record_type = 'response'").withColumn("_ok", F.assert_true("verified", "a payload's digest does not hold"))
    return checked.where("_ok is null").groupBy("sha256").agg(F.first("payload").alias("payload"))


def header_store(records: DataFrame) -> DataFrame:
    """The exact header bytes of each record, with the address of its payload."""
    return records.select("id", "record_type", "refers_to", "payload_digest", "sha256", "header", "record_sha1")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """All rows with their payload, and the record's bytes as archived (of a revisit without payload).

    A row whose payload is in no store, or whose record doesn't come out as it was, raises.
    """
    joined = headers.join(payloads, "sha256", "left")
    own = F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(END.encode()))
    same = F.coalesce(F.sha1(own) == F.col("record_sha1"), F.lit(False)) & F.col("payload").isNotNull()
    return joined.withColumn("record", F.when(same, own).otherwise(F.raise_error(F.lit("a record can't be rebuilt")).cast("binary")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS data FROM pages),
d AS (SELECT page_id, strlen(data)::BIGINT AS payload_bytes, sha1(data) AS h, sha256(data) AS s FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS best FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""
