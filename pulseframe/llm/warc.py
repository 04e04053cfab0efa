"""WARC archives of pages: written by Spark with revisit records for repeated payloads, read back by a salvage reader.

The reader checks every record: version line, header lines, length, the blank lines behind the block and the block digest.
Where a check fails it searches for the next gzip member or version line, goes on there, and reports the bytes between as
a gap. Archives are gzip files of plain records; the reader also takes one member per record and uncompressed files.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.words import bound_batches
from pulseframe.session import work_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes that are inflated in one call.
SLICE = 1 << 14

_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(rb"<urn:(x-page:(-?\d+)?|uuid:[0-9A-Fa-f-]{36})>")
_PAGE = re.compile(rb"<urn:x-page:(-?\d+)>")


def write_pages(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """One record for each row of ``pages(page_id, url, html)``; the payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and the others
    are revisits that refer to it; all others are responses. Equal payloads that share the largest page_id, or have none, are
    all responses. A row without page_id has a record without number.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    known = rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    known = known.where("n > 1 and top is not null").select("d", "top")
    rows = rows.join(known, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    again = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(line + line))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    number = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    rows = rows.select("page_id", "top", "digest", F.regexp_replace("url", r"\s", "%20").alias("url"), again.alias("again"), block.alias("block"))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: "), number("page_id"), F.lit(f"{line}WARC-Date: {CAPTURED}{line}WARC-Target-URI: "), F.col("url"),
        F.when(F.col("again"), F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: "), number("top"))).otherwise(F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{line}WARC-Block-Digest: sha1:"), F.sha1(F.encode("block", "UTF-8")),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length("block").cast("string"), F.lit(line + line))
    rows.select(F.concat(head, "block")).write.option("lineSep", line + line).option("compression", "gzip").text(path)


def _record(data: bytes, at: int) -> tuple[dict[bytes, bytes], bytes, int]:
    """Header, block and end of the record at ``at``; raises ValueError with the check that failed."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise ValueError("header without end")
    header = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        header[name.strip().lower()] = value.strip()
    size = header.get(b"content-length", b"")
    if not size.isdigit():
        raise ValueError("no content length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where it should")
    block = data[start:stop]
    told = header.get(b"warc-block-digest")
    if told and told.lower() != b"sha1:" + hashlib.sha1(block).hexdigest().encode():
        raise ValueError("block digest differs")
    return header, block, stop + 4


def _plain_records(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (header, block, doubt)) and ("gap", start, end, reason) of uncompressed bytes, in order."""
    at = 0
    while at < len(data):
        try:
            header, block, end = _record(data, at)
        except ValueError as reason:
            found = _VERSION.search(data, at + 1)
            end = found.start() if found else len(data)
            yield "gap", at, end, str(reason)
        else:
            yield "record", at, end, (header, block, None)
        at = end


def read_archive(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of an archive's bytes, in order. For records in gzip members and for gaps inside a member that opens,
    the positions are those of the member; a member that breaks gives its whole records, the gaps inside what it gave, and a gap
    for what is lost up to the next one. Its records carry a doubt, since no digest covers their headers."""
    at = 0
    while at < len(data):
        if not data.startswith(_MEMBER, at):
            end = data.find(_MEMBER, at + 1)
            # Plain bytes hold the member mark by chance: they end there only if a member opens.
            while end >= 0 and not _opens(data, end):
                end = data.find(_MEMBER, end + 1)
            end = end if end >= 0 else len(data)
            for kind, x, y, what in _plain_records(data[at:end]):
                yield kind, at + x, at + y, what
            at = end
            continue
        output, end, reason = _inflated(data, at)
        if reason:
            end = data.find(_MEMBER, at + 1)
            while end >= 0 and not _opens(data, end):
                end = data.find(_MEMBER, end + 1)
            end = end if end >= 0 else len(data)
        for kind, _, _, what in _plain_records(output):
            if reason and kind == "record":
                # Digests cover blocks only: what the damage did to a header line is seen in the id at best.
                header, block, _ = what
                if b"warc-block-digest" not in header or not _ID.fullmatch(header.get(b"warc-record-id", b"")):
                    yield "gap", at, end, "record of a broken member without whole id and block digest"
                    continue
                what = header, block, f"header not covered by a digest, {reason}"
            yield kind, at, end, what
        if reason:
            yield "gap", at, end, reason
        at = end


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """All bytes that the member at ``at`` gives, its end, and why it breaks ("" if it does not). The call that fails gives nothing,
    so the input goes in slices; the slice that fails is repeated byte by byte."""
    machine, parts = zlib.decompressobj(31), []
    x = at
    while x < len(data) and not machine.eof:
        piece = data[x : x + SLICE]
        before = machine.copy()
        try:
            parts.append(machine.decompress(piece))
        except zlib.error as error:
            for k in range(len(piece)):
                try:
                    parts.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(parts), x, f"member broken: {error}"
        x += len(piece)
    if machine.eof:
        return b"".join(parts), x - len(machine.unused_data), ""
    return b"".join(parts), x, "member breaks off"


def _opens(data: bytes, at: int) -> bool:
    """Whether a member that begins here gives at least a version line."""
    try:
        return _VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 64)) is not None
    except zlib.error:
        return False


_SCHEMA = "file string, start long, end long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, reason string"


def _reader(payloads: bool):
    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for kind, start, end, what in read_archive(content.as_py()):
                    if kind == "gap":
                        rows.append((path, start, end, "gap", None, None, None, None, None, None, what))
                        continue
                    header, block, doubt = what
                    page, refers = (_PAGE.match(header.get(n, b"")) for n in (b"warc-record-id", b"warc-refers-to"))
                    revisit = header.get(b"warc-type") == b"revisit"
                    body = None if revisit else block.partition(b"\r\n\r\n")[2]
                    digest = None if revisit else hashlib.sha1(body).hexdigest()
                    reason = None if revisit or header.get(b"warc-payload-digest", b"sha1:" + digest.encode()).lower() == b"sha1:" + digest.encode() else "payload digest differs"
                    reason = reason or doubt
                    rows.append((path, start, end, header.get(b"warc-type", b"").decode("latin-1"), int(page[1]) if page else None, int(refers[1]) if refers else None,
                                 header.get(b"warc-target-uri", b"").decode("utf-8", "replace"), None if revisit else len(body), digest, body if payloads else None, reason))
                    if len(rows) >= 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives under ``path``: file, start, end, record_type (``gap`` for gaps),
    page_id, refers_to, url, payload_bytes, payload_digest, payload, reason. Revisits carry no payload. Files are read whole,
    one at a time; the writer's partitions bound their size. An empty folder gives no rows."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take length and digest of their response."""
    rows = records.where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("target")).agg(
        F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    revisits = rows.where("record_type = 'revisit'").join(whole, F.col("refers_to") == F.col("target"), "left")
    return rows.where("record_type = 'response'").unionByName(
        revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared work folder and read them back: one row per page, see ``write_pages`` and ``resolved``."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_pages(pages, path)
    from pulseframe.session import materialise

    return resolved(materialise(read_records(spark, path, payloads=False).drop("payload"), "records"))
