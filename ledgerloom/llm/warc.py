"""WARC: archives of captures, and the assembly of their records into transactions.

Writing: each page becomes a request, a response or revisit, and a metadata
record, which name the response in WARC-Concurrent-To.  Spark's text sink
writes them, with the blank lines that end a record as its line separator, to
any store Spark can write to, as gzip files of bounded size.

Reading: files are unpacked piece by piece; records are cut by Content-Length,
never by what a payload holds, and put together again through
WARC-Concurrent-To, whichever record names which, into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdBitmap, materialize, scratch
from .mixing import repeated

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A file has at most so many captures and, but for a single larger one, so many bytes before it is packed.
PER_FILE, FILE_BYTES = 4000, 1 << 28
#: Bytes that a reader unpacks at once, and payload bytes of the records that it passes on together.
_CHUNK, _TOGETHER = 1 << 20, 1 << 25
#: Records that are a capture themselves.
OWN = ("response", "revisit", "resource")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four groups of 40 bits, each eight digits of base 32."""
    digest = F.sha1(payload)
    group = lambda i: F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0")
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*(group(i) for i in range(4))), digits, letters)


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        parts += [F.lit(name + ": "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF)]
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``page_id``, ``url``, ``html`` as WARC files below ``path``.

    Of pages with equal payloads of at least ``min_bytes``, those with the
    smallest page_id are responses, all others revisits that name it.  A null
    html is an empty payload, a null url an empty target; rows that repeat a
    page_id and a payload are captures of their own; a null page_id never
    makes others revisits.  Ids and digests alone are exchanged to find equal
    payloads; payloads that occur once are written where they are read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    light = materialize(rows.groupBy("page_id", "digest", "bytes").agg(F.count("*").alias("n")), "digests")
    longest = light.agg(F.max("bytes").alias("bytes")).first().bytes or 0
    firsts = light.groupBy("digest").agg(F.sum("n").alias("_rows"), F.min("page_id").alias("first"))
    firsts = materialize(firsts.where("_rows > 1").select(F.col("digest").alias("_d"), "first"), "repeated")
    bitmap = IdBitmap(firsts)
    alone = bitmap.keep(rows, "digest", others=True).withColumns({"first": F.lit(None).cast("long"), "nth": F.lit(1).cast("long")})
    some = bitmap.keep(rows, "digest").join(firsts, F.col("digest") == F.col("_d"), "left").drop("_d")
    # Rows that are wholly equal meet as one in each task before they are moved.
    some = some.groupBy("page_id", "digest", "url").agg(F.first("html").alias("html"), F.first("bytes").alias("bytes"), F.first("first").alias("first"), F.count("*").alias("_n"))
    some = repeated(some, F.col("_n"), "nth").withColumn("nth", F.col("nth") + 1).drop("_n")
    several = (F.col("bytes") >= min_bytes) & (F.col("page_id") > F.col("first"))
    rows = alone.unionByName(some).withColumn("first", F.when(several, F.col("first")))
    per_file = max(1, min(PER_FILE, FILE_BYTES // (longest + 2048)))
    again = F.col("first").isNotNull()

    name = lambda page, nth, kind: F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(":"), nth.cast("string"), F.lit(f":{kind}>"))
    this = name(F.col("page_id"), F.col("nth"), "response")
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    common: list[tuple[str, Column | str]] = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", name(F.col("page_id"), F.col("nth"), "request")), *common, ("WARC-Concurrent-To", this), ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF + CRLF)),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html;charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    shared: list[tuple[str, Column | str]] = [("WARC-Record-ID", this), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http;msgtype=response")]
    response = _record([("WARC-Type", "response"), *shared], F.concat(http, F.col("html")))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(F.col("first"), F.lit(1), "response")), *shared], http)
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", name(F.col("page_id"), F.col("nth"), "metadata")), *common, ("WARC-Concurrent-To", this), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF)),
    )
    end = CRLF + CRLF
    whole = F.concat(request, F.lit(end), F.when(again, revisit).otherwise(response), F.lit(end), metadata)
    rows.select(whole.alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", per_file).text(path, compression="gzip")


RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>, payload binary"
_NAMES = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "payload_bytes", "payload_digest", "intact", "fields", "payload"]
_KINDS = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]


class Unpacked:
    """The bytes of a file, plain or gzip of one or many members, unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.rest, self.member, self.have, self.at = memoryview(data), None, bytearray(), 0
        self.gzip = data[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Unpack a little more; false at the end of the file."""
        while len(self.rest):
            part = self.rest[:_CHUNK]
            if not self.gzip:
                self.rest = self.rest[_CHUNK:]
                self.have += part
                return True
            self.member = self.member or zlib.decompressobj(31)
            out = self.member.decompress(part, _CHUNK)
            left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.rest = self.rest[len(part) - len(left) :]
            self.member = None if self.member.eof else self.member
            if out:
                self.have += out
                return True
        return False

    def find(self, mark: bytes) -> int:
        """Where the mark ends, from here; -1 if it doesn't come."""
        start = 0
        while (found := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                return -1
        return found + len(mark)

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        self.at += len(out)
        return out


def _headers(raw: bytes, at: int) -> dict[str, list[str]]:
    lines = raw.decode("utf-8", "replace").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    headers: dict[str, list[str]] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            headers[last][-1] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers.setdefault(last, []).append(value.strip())
    return headers


def payload_of(block: bytes, content_type: str) -> bytes:
    """What a block holds behind its HTTP header; all of it where there is none, nothing where the header is all."""
    if not (content_type.startswith("application/http") or block.startswith(b"HTTP/")):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b"" if block.startswith(b"HTTP/") else block


def parsed(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one file, one at a time."""
    file = Unpacked(data)
    while True:
        while file.have[:1] in (b"\r", b"\n") or (not file.have and file.more()):  # what stands between records
            file.take(1 if file.have[:1] in (b"\r", b"\n") else 0)
        if not file.have:
            return
        at, end = file.at, file.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = _headers(file.take(end)[:-4], at)
        one = lambda name, h=headers: h.get(name, [None])[0]
        length = int(one("content-length"))
        block = file.take(length)
        if len(block) != length:
            raise ValueError(f"a record of {length} bytes ends early at byte {file.at}")
        kind, fields, payload, n, digest, intact = one("warc-type"), None, None, None, None, True
        said = one("warc-payload-digest") or ""
        said = said[5:] if said.lower().startswith("sha1:") else None
        if kind in ("response", "resource"):
            payload = payload_of(block, one("content-type") or "")
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            intact = said in (None, digest)
        elif kind == "revisit":
            digest = said
        elif kind == "metadata":
            fields = list({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)}.items())
        yield one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), n, digest, intact, fields, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the WARC files below ``path``; gzip files of one or many members, or plain ones."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for files in batches:
            for value in files.column(0):
                for row in parsed(value.as_py(), with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) == 1024 or size > _TOGETHER:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its record id, and its request, response (or revisit, or resource) and metadata records, null where there is none.

    A record belongs to the captures that any of its WARC-Concurrent-To name,
    to those that name it, and, where it names neither, to those of the record
    that it names.  Of several requests or metadata records of one capture that
    with the smallest id is taken; of several responses of one id, too.  Records
    that lead to no capture are left out.
    """
    records = materialize(records, "records")
    own = F.col("type").isin(*OWN)
    body = F.struct("record_id", "type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "intact", "payload")
    asked = F.when(F.col("type") == "request", F.struct("record_id", "target_uri"))
    note = F.when(F.col("type") == "metadata", F.struct("record_id", F.map_entries("fields").alias("fields")))
    least = lambda df: df.groupBy("capture").agg(*(F.min(c).alias(c) for c in ("request", "response", "metadata")))
    captures = records.where(own).select(F.col("record_id").alias("capture"), F.lit(None).cast("struct<record_id:string,target_uri:string>").alias("request"), body.alias("response"), F.lit(None).cast("struct<record_id:string,fields:array<struct<key:string,value:string>>>").alias("metadata"))
    parts = records.where(F.col("type").isin("request", "metadata")).select("record_id", "concurrent_to", asked.alias("request"), note.alias("metadata"))
    no_body = F.lit(None).cast(captures.schema["response"].dataType).alias("response")
    rows = captures.unionByName(parts.select(F.explode("concurrent_to").alias("capture"), "request", no_body, "metadata"))
    # Captures that name others: these get them as well.
    naming = records.where(own).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    named = not naming.isEmpty()
    if named:
        rows = rows.unionByName(parts.join(naming, "record_id").select("capture", "request", no_body, "metadata"))
    found = materialize(least(rows), "captures")
    whole = found.where("response IS NOT NULL")
    # What named a record that is no capture goes to the captures of that record.
    astray = found.where("response IS NULL").select(F.col("capture").alias("record_id"), "request", "metadata")
    if astray.isEmpty():
        return whole
    leads = parts.select("record_id", F.explode("concurrent_to").alias("capture"))
    leads = leads.unionByName(naming.select("record_id", "capture")) if named else leads
    led = astray.join(leads.join(whole.select("capture"), "capture", "left_semi").distinct(), "record_id")
    return least(whole.unionByName(led.select("capture", "request", no_body, "metadata")))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and digest each capture."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_bytes)
    captures = assemble(read_records(spark, path, with_payload=False))  # digests and lengths are of the whole payloads
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    noted = F.map_from_entries("metadata.fields")["payload-bytes"].try_cast("long")
    good = F.col("response.intact") & F.coalesce(F.col("response.payload_bytes") == noted, F.lit(True))
    return captures.select(
        page(F.col("capture")).alias("page_id"),
        F.when(good, F.coalesce(F.col("response.payload_bytes"), noted)).otherwise(F.raise_error(F.lit("a payload differs from its digest or length"))).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page(F.col("response.refers_to")).alias("refers_to"),
    )


SQL = """
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, payload_bytes, translate(
    lpad(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32), 8, '0') ||
    lpad(to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM hashed
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""
