"""Legacy archive converter: ARC files in, WARC files out, and readers for both.

An ARC record is one header line (5 fields in version 1, 10 in version 2) and as many bytes as its last field
declares; `filedesc://` records state the version that follows. Each record becomes a WARC record with a
synthesised identifier, ISO timestamp, type and payload digest. Of equal payloads one record is the response, the
others are revisits that refer to it and carry no payload.

Archives are written by Spark's own file writer (a WARC record ends with two line ends, which is the separator it
writes), so any store that Spark knows can hold them and a lost task is written again; a file holds a bounded
number of records. Readers stream through one file a time.

Defined results: a null payload is empty; an empty payload has a digest and may be revisited like any other; null
or blank URLs become urn:page:<id>; white space in a URL is escaped; repeated rows give repeated records, of which
those that are not the one with the largest id are revisits (rows that share the largest id are all responses);
rows without an id have none to refer by and keep null; a header line may have any length; version 1 has no field for
the page's number, so records of such archives come back with a null page_id; an empty table gives an empty archive and no rows. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, table

RECORDS_PER_FILE = 10_000
ROWS_PER_BATCH = 200
#: The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = "\r\n\r\n"


class ArchiveError(ValueError):
    """A header line or a declared length that an archive doesn't keep."""


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    mime: str
    payload: bytes
    status: str = "200"
    filename: str = "-"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Source:
    """A buffered reader over bytes that may be (multi-member) gzip."""

    def __init__(self, content: bytes):
        self.file = io.BufferedReader(_Unzipped(content), 1 << 18) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)

    def line(self) -> bytes:
        return self.file.readline()

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) != n:
            raise ArchiveError(f"{n} bytes declared, {len(out)} there")
        return out


class _Unzipped(io.RawIOBase):
    def __init__(self, content: bytes):
        self.left, self.zip = content, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.zip.eof:
                self.left, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            if not self.left:
                return 0
            out = self.zip.decompress(self.left, len(into))
            self.left = b"" if self.zip.eof else self.zip.unconsumed_tail
            if self.zip.eof and self.zip.unused_data:
                self.left = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, version blocks left out."""
    source, version = _Source(content), 0
    while line := source.line():
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if line.startswith(b"filedesc://"):
            if not fields[-1].isdigit():
                raise ArchiveError(f"bad version block: {line[:80]!r}")
            version = int(source.take(int(fields[-1])).split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ArchiveError(f"version {version}")
            continue
        kind = version or {len(v): k for k, v in ARC_FIELDS.items()}.get(len(fields), 0)
        if kind not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[kind]) or not fields[-1].isdigit():
            raise ArchiveError(f"bad header line: {line[:80]!r}")
        named = dict(zip(ARC_FIELDS[kind], fields, strict=True))
        yield ArcRecord(
            kind, named["url"], named["ip"], named["date"], named["mime"], source.take(int(named["length"])),
            named.get("status", "200"), named.get("filename", "-"),
        )


@dataclass
class WarcRecord:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.fields.get("content-type", "") else self.block


def parse_warc(content: bytes) -> Iterator[WarcRecord]:
    source = _Source(content)
    while line := source.line():
        if line in (b"\n", b"\r\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ArchiveError(f"no WARC version: {line[:80]!r}")
        fields = {}
        while (line := source.line()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ArchiveError("no content-length")
        yield WarcRecord(fields, source.take(int(fields["content-length"])))


def arc_text(pages: DataFrame, id_col: str, url: str, payload: str, captured: str, version: int = 2) -> DataFrame:
    """One ARC record a row, as text; a version block goes before the first of each file."""
    body = F.coalesce(F.col(payload), F.lit(""))
    bare = F.coalesce(F.col(url), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    named = F.when(F.trim(bare) == "", F.concat(F.lit("urn:page:"), key)).otherwise(F.regexp_replace(bare, r"\s", "%20"))
    size = F.octet_length(body).cast("string")
    if version == 1:
        record = F.concat_ws(" ", named, F.lit("0.0.0.0"), F.lit(captured), F.lit("text/html"), size)
    else:
        record = F.concat_ws(
            " ", named, F.lit("0.0.0.0"), F.lit(captured), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"),
            F.lit("0"), F.concat(F.lit("page-"), key), size,
        )
    block = f"{version} 0 lakesift\n{ARC_TITLES[version]}\n"
    head = f"filedesc://pages.arc 0.0.0.0 {captured} text/plain " + ("200 - - 0 pages.arc " if version == 2 else "")
    opening = F.lit(f"{head}{len(block)}\n{block}\n")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % RECORDS_PER_FILE
    return pages.select(
        F.concat(F.when(place == 0, opening).otherwise(F.lit("")), record, F.lit("\n"), body).alias("value")
    )


def write_records(records: DataFrame, path: str, line_end: str) -> None:
    records.write.option("lineSep", line_end).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


ARC_ROWS = "page_id long, url string, date string, mime string, status string, payload string, payload_bytes long, payload_digest string"


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for r in parse_arc(content.as_py()):
                    key = r.filename.removeprefix("page-")
                    page = int(key) if key.lstrip("-").isdigit() else None
                    text = r.payload.decode("utf-8", "replace")
                    yield page, r.url, r.date, r.mime, r.status, text, len(r.payload), base32_sha1(r.payload)

    names = ["page_id", "url", "date", "mime", "status", "payload", "payload_bytes", "payload_digest"]
    return _batched(rows(), names, [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files of a folder, with payload lengths and digests."""
    return _files(spark, path).mapInArrow(_arc_rows, ARC_ROWS)


def _urn(key: Column) -> Column:
    h = F.md5(key)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def to_warc(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC records as text, from records as read_arc gives them. Only a response carries its payload."""
    groups = (
        records.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1").select("payload_digest", "original")
    )
    known = records.join(groups, "payload_digest", "left").withColumn(
        "original", F.when((F.col("payload_bytes") >= least_bytes) & (F.col("original") != F.col("page_id")), F.col("original"))
    )
    revisit = F.col("original").isNotNull()

    def urn(page: str) -> Column:
        return _urn(F.concat(F.lit("page "), F.coalesce(F.col(page).cast("string"), F.concat(F.col("url"), F.col("date")))))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    d = F.col("date")
    iso = F.concat(
        F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)), F.lit("T"),
        F.concat_ws(":", F.substring(d, 9, 2), F.substring(d, 11, 2), F.substring(d, 13, 2)), F.lit("Z"),
    )
    http = F.concat(
        F.lit("HTTP/1.1 "), F.col("status"), F.lit(" OK\r\nContent-Type: "), F.col("mime"), F.lit("\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return known.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            field("WARC-Record-ID", urn("page_id")),
            field("WARC-Date", iso),
            field("WARC-Target-URI", F.col("url")),
            field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            F.when(
                revisit,
                F.concat(
                    field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    field("WARC-Refers-To", urn("original")),
                    field("Refers-To-Page-Id", F.col("original").cast("string")),
                ),
            ).otherwise(F.lit("")),
            field("Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
            field("Payload-Length", F.col("payload_bytes").cast("string")),
            field("Content-Type", F.lit("application/http; msgtype=response")),
            field("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("value")
    )


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for r in parse_warc(content.as_py()):
                    f = r.fields
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["payload-length"])
                    if f["warc-type"] == "response" and (len(r.payload) != size or base32_sha1(r.payload) != digest):
                        raise ArchiveError(f"payload of {f['warc-record-id']} isn't what its digest says")
                    page, to = f["page-id"], f.get("refers-to-page-id")
                    yield None if page == "-" else int(page), size, digest, f["warc-type"], int(to) if to else None, f["warc-record-id"], f["warc-date"]

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return _batched(rows(), names, types)


WARC_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of all WARC files of a folder; payloads are held against their digests."""
    return _files(spark, path).mapInArrow(_warc_rows, WARC_ROWS)


def archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", captured: str = "20240101000000", keep_legacy: bool = False) -> DataFrame:
    """Writes pages as legacy archives, converts those to WARC, and reads the WARC files back.

    The legacy files go when they are converted, unless keep_legacy."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    own = pages.select(
        F.col(id_col).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(payload).cast("string").alias("p")
    )
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_records(arc_text(own, "i", "u", "p", captured), arc, "\n")
    converted = scratch.write(read_arc(spark, arc), "converted")
    if not keep_legacy:
        scratch.drop_path(arc)
    write_records(to_warc(converted), warc, RECORD_END)
    return read_warc(spark, warc)


def query(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hexed: str) -> str:
    """Base32 of a 40-digit hexadecimal string, 5 bits a letter, in SQL."""
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + strpos('0123456789abcdef', {hexed}[i]) - 1), 4)), '')"
    return (
        "array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'["
        f"1 + list_sum(list_transform(range(1, 6), lambda k: CASE WHEN {bits}[5 * j + k] = '1' THEN 1 << (5 - k) ELSE 0 END))::INT]), '')"
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_base32_sql('h')} AS payload_digest,
  CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p JOIN g USING (h)"""
