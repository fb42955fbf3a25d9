"""Web archives: a writer that refers repeated payloads to one record, and a salvage reader.

An archive is a sequence of records, each a gzip member of its own or plain between version
lines. The reader checks every record; after a failed check it looks for the next member or
version line that passes, goes on there and reports the bytes it left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import join_groups, pieces_of, small_batches, whole_text
from driftline.session import new_folder

VERSION = b"WARC/1.1"
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes that a header, and those that an HTTP header, may take.
HEADER_BYTES = 1 << 20
_MEMBER = b"\x1f\x8b\x08"
_FED = 1 << 14  # bytes given to the unpacker at a time
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"


# records ----------------------------------------------------------------------

def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, as archives state it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, date: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One record with its closing lines."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **fields,
            "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """The url without bytes that would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def page_record(page_id, url: str | None, payload: bytes, refers_to, repeat: bool,
                date: str) -> bytes:
    """The response record of a page, or the revisit record that names another page's."""
    fields = {"WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
              "X-Payload-Length": str(len(payload))}
    if url is not None:
        fields["WARC-Target-URI"] = _uri(url)
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    own = "urn:page:" + ("" if page_id is None else _uri(str(page_id)))
    head = _HTTP % len(payload)
    if not repeat:
        return record("response", own, date, head + payload, fields)
    fields |= {"WARC-Refers-To": f"<urn:page:{_uri(str(refers_to))}>", "X-Refers-To": str(refers_to),
               "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", own, date, head, fields)


# reading ----------------------------------------------------------------------

class Damaged(ValueError):
    """A record that fails a check."""


@dataclass(frozen=True)
class Record:
    """A record that passed, and where its bytes stand in the archive."""

    start: int
    end: int
    fields: dict[str, str]  # names in lower case
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header; all of it where there is none."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        at = self.block.find(b"\r\n\r\n", 0, HEADER_BYTES)
        return self.block[at + 4:] if at >= 0 else b""


@dataclass(frozen=True)
class Gap:
    """Bytes that were left out, and why."""

    start: int
    end: int
    reason: str


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``; raises :class:`Damaged`."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    fields, place = {}, line.end()
    while True:
        stop = data.find(b"\n", place, place + HEADER_BYTES)
        if stop < 0:
            raise Damaged("header without an end")
        text = data[place:stop].rstrip(b"\r")
        place = stop + 1
        if not text:
            break
        name, colon, value = text.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line without a name")
        try:
            fields[name.strip().decode().lower()] = value.strip().decode()
        except UnicodeDecodeError:
            raise Damaged("header is not UTF-8") from None
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    end = place + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("content does not end where its length says")
    return fields, data[place:end], end + 4


def checked(start: int, end: int, fields: dict[str, str], block: bytes) -> Record:
    """The record, after its type, identity and digest have been checked."""
    found = Record(start, end, fields, block)
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(name):
            raise Damaged(f"no {name}")
    for name, content in (("warc-block-digest", lambda: block),
                          ("warc-payload-digest", lambda: found.payload)):
        stated = fields.get(name, "")
        if name == "warc-payload-digest" and fields["warc-type"] == "revisit":
            continue  # the payload is elsewhere
        if stated.lower().startswith("sha1:") and stated[5:].upper() != digest_of(content()):
            raise Damaged(f"{name} differs")
    return found


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and its end."""
    unpack, view, plain, place = zlib.decompressobj(31), memoryview(data), [], at
    while not unpack.eof:
        piece = view[place:place + _FED]
        if not piece:
            raise Damaged("member is cut off")
        try:
            plain.append(unpack.decompress(piece))
        except zlib.error:
            raise Damaged("member does not unpack") from None
        place += len(piece)
    return b"".join(plain), place - len(unpack.unused_data)


def _read(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The member's records, or the one plain record, at ``at``, and their end."""
    if not data.startswith(_MEMBER, at):
        fields, block, end = parse(data, at)
        return [checked(at, end, fields, block)], end
    plain, end = _member(data, at)
    inside = list(salvage(plain))
    gaps = [x for x in inside if isinstance(x, Gap)]
    sound = [replace(x, start=at, end=end) for x in inside if isinstance(x, Record)]
    if gaps and not sound:
        raise Damaged(gaps[0].reason)
    return [Gap(at, end, f"in a member: {gaps[0].reason}"), *sound] if gaps else sound, end


def _next(data: bytes, at: int) -> int:
    """Where the next member or version line may begin, at ``at`` or later."""
    member = data.find(_MEMBER, at)
    line = _VERSION_LINE.search(data, at, member if member >= 0 else len(data))
    if line:
        return line.start()
    return member if member >= 0 else len(data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every record of an archive that passes its checks, in order, and the gaps between.

    A gap keeps the reason of its first failed check and reaches to the next sound record.
    All bytes of the archive belong to one record, a gap or an empty member; a member that
    holds sound and damaged records is a gap and gives its sound records as well.
    """
    at, gap = 0, None
    while at < len(data):
        try:
            found, end = _read(data, at)
        except Damaged as error:
            gap = gap or (at, str(error))
            at = _next(data, at + 1)
            continue
        if gap:
            yield Gap(gap[0], at, gap[1])
            gap = None
        yield from found
        at = end
    if gap:
        yield Gap(gap[0], len(data), gap[1])


# tables -----------------------------------------------------------------------

def refer_repeats(pages: DataFrame, id_column: str = "page_id",
                  payload_column: str = "html") -> DataFrame:
    """``pages`` with __payload, __first (the smallest id of its group, if any) and __repeat.

    Pages whose payloads are the same bytes (SHA-256 and length) form a group; the smallest
    id is the one that others refer to. A null id is never the smallest; a group of null ids
    refers to nothing. Rows that share the smallest id all keep their payload.
    """
    rows = pages.withColumn("__payload", whole_text(payload_column).cast("binary"))
    rows = rows.withColumn("__key", F.coalesce(F.unhex(F.sha2("__payload", 256)), F.lit(b"")))
    groups = rows.groupBy("__key").agg(F.min(id_column).alias("__first"),
                                       F.count(F.lit(1)).alias("__n"))
    groups = groups.where((F.col("__n") > 1) & F.col("__first").isNotNull())
    joined = join_groups(rows, groups, "__key", "__n")
    repeat = F.col("__first").isNotNull() & ~F.col(id_column).eqNullSafe(F.col("__first"))
    return joined.withColumn("__repeat", repeat)


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id",
                   url_column: str = "url", payload_column: str = "html",
                   compress: bool = True, date: datetime | None = None,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record for each row of ``pages``, in archives of some ``archive_bytes``.

    Every record is a gzip member of its own, or plain. Tasks hand archives to Spark's file
    writer, so they reach any store that Spark writes to, and a lost task leaves none. A
    task holds one archive and one page.
    """
    small_batches(pages.sparkSession)
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lean = pages.select(F.col(id_column).alias("__id"),
                        F.col(url_column).cast("string").alias("__url"),
                        F.col(payload_column).alias("__html"))
    rows = refer_repeats(lean, "__id", "__html").select(
        F.col("__id").cast("string").alias("__id"), "__url",
        F.col("__first").cast("string").alias("__first"), "__repeat", "__payload")

    def run(batches):
        parts, size = [], 0
        for batch in (x for whole in batches for x in pieces_of(whole, 4)):
            for page_id, url, first, repeat, payload in zip(*(c.to_pylist() for c in batch.columns)):
                found = page_record(page_id, url, payload, first, repeat, stamp)
                parts.append(gzip.compress(found, 6, mtime=0) if compress else found)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_closed(parts)])], ["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([_closed(parts)])], ["archive"])

    def _closed(parts):
        whole = b"".join(parts)
        return whole if compress else whole[:-4]  # the writer adds the last closing lines

    ending = _EMPTY_MEMBER if compress else b"\r\n\r\n"
    (rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", ending.decode("latin-1")).text(folder))


RECORD = ("archive string, start long, end long, record_type string, record_id string, "
          "target_uri string, page_id string, payload_digest string, payload_bytes long, "
          "refers_to string, payload binary, gap_reason string")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in ``folder`` (:data:`RECORD`).

    A gap has a reason and no record type. A revisit has the digest and length that it
    states; of other records both are computed from the payload. An archive is read by one
    task, in memory; ``binaryFile`` reads those below 2 GB.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = T._parse_datatype_string(RECORD)
    names = schema.fieldNames()
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(),
                                 "binary": pa.binary()}[f.dataType.simpleString()])
                       for f in schema])

    def rows_of(path, data):
        for found in salvage(data):
            if isinstance(found, Gap):
                yield {"archive": path, "start": found.start, "end": found.end,
                       "gap_reason": found.reason}
                continue
            fields, payload = found.fields, found.payload
            revisit = fields["warc-type"] == "revisit"
            stated = fields.get("x-payload-length", "")
            yield {
                "archive": path, "start": found.start, "end": found.end,
                "record_type": fields["warc-type"], "record_id": fields["warc-record-id"],
                "target_uri": fields.get("warc-target-uri"), "page_id": fields.get("x-page-id"),
                "payload_digest": fields.get("warc-payload-digest", "")[5:] or None if revisit
                else digest_of(payload),
                "payload_bytes": (int(stated) if stated.isdigit() else None) if revisit
                else len(payload),
                "refers_to": fields.get("x-refers-to"),
                "payload": payload if with_payload and not revisit else None}

    def run(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in rows_of(path, data):
                    held.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return files.mapInArrow(run, schema).select(*names)


def archive_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                  payload_column: str = "html") -> DataFrame:
    """Write ``pages`` to archives and read them back: one row per page.

    page_id, payload_bytes, payload_digest, record_type (response or revisit) and refers_to
    (the id whose payload a revisit repeats). A null payload is empty, a null id stays null,
    a null url is left out. The archives lie in a new folder under ``spark.checkpoint.dir``.
    Empty tables give empty archives and no rows. A gap in what was just written is an error.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, id_column, url_column, payload_column)
    kind = pages.schema[id_column].dataType
    found = read_archives(spark, folder, with_payload=False)
    whole = F.when(F.col("gap_reason").isNotNull(), F.raise_error(F.concat(
        F.lit("gap in "), "archive", F.lit(": "), "gap_reason")).cast("boolean")).otherwise(F.lit(True))
    return found.where(whole).select(
        F.col("page_id").cast(kind).alias(id_column), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
