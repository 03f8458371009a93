"""Operator 2: WARC archives, written as Spark text and read back by a salvage reader.

Writing: each record is a gzip member and Spark's text writer puts it in a file, the last byte of the member (always 0)
being the writer's line end.  So archives land wherever Spark can write, through its committer, and a lost executor leaves
no half-written archive.  Archives are kept to about ``archive_bytes`` of payload each, since a reader task holds one.

Reading: ``binaryFile`` rows, each parsed by :func:`salvage`.  A record whose checks fail (version line, length, record
end, digests) doesn't end the archive: the reader searches for the next version line or gzip member that holds a valid
record, goes on from there and reports the bytes between as a quarantined gap.  A gzip member may hold several records, and
gaps between them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, scratch_path, written

ARCHIVE_BYTES = 16 << 20
MEMBER_BYTES = (16 << 20) - 1
#: Parts that the rows of one page_id are dealt to, so that an id (or null) with very many rows isn't one task.
SALTS = 16
RECORDS = (
    "archive string, at long, inner long, length long, record_type string, record_id string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing -------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 40 bits (10 hex digits, 8 base32 digits) at a time."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, response), once each, of the payloads that others share and whose page isn't the response.

    Of equal payloads of at least ``least_bytes`` bytes the largest page_id is the response; null ids are never one, nor do
    their pages revisit another; repeated rows count once; an empty table gives no rows.  Only ids and digests are shuffled; a
    digest's pages are summed up where they are read, and the join back has one row a digest on one side, so Spark can split a
    digest with very many pages.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    narrow = written(pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("bytes")), "digests")
    first = narrow.where(F.col("bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    shared = narrow.join(first.where("n > 1").select("payload_digest", "response"), "payload_digest")
    return shared.where("page_id != response").select("page_id", "payload_digest", "response").distinct()


def record(date: str) -> Column:
    """The whole WARC record of a (page_id, url, payload, payload_bytes, payload_digest, refers_to) row."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(_HTTP.encode())).otherwise(F.concat(F.lit(_HTTP.encode()), F.col("payload")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nWARC-Block-Digest: sha1:"),
        base32_sha1(block),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n"))


def members(data: bytes) -> bytes:
    """The record as a gzip member without its last byte, which is always 0: it is the highest of the length's four, and
    records of 16 MiB or more become several members."""
    parts = [gzip.compress(data[i : i + MEMBER_BYTES], 6, mtime=0) for i in range(0, max(1, len(data)), MEMBER_BYTES)]
    return b"".join(parts)[:-1]


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write one record a row of ``pages`` (page_id, url, html) to archives under ``path``.

    Null html is an empty payload; a null url is an empty target; repeated rows give repeated records; an empty table
    gives no records.
    """
    total = pages.agg(F.coalesce(F.sum(F.octet_length(F.col("html").cast("string")) + 600), F.lit(0))).first()[0]
    archives = int(max(1, -(-total // archive_bytes)))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Pages are dealt out to archives once, and their revisits come to them there.  Rows of one id and payload are told apart by
    # url and by where they were read, so no archive gets all of them.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    key = ["page_id", "payload_digest", "salt"]
    mine = revisits(pages, least_bytes).withColumn("salt", F.explode(salts)).repartition(archives, *key)
    known = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("url", F.spark_partition_id()), F.lit(SALTS)).cast("int")).repartition(archives, *key)
    told = dealt.join(mine, key, "left").withColumnRenamed("response", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": pa.array([members(x.as_py()) for x in b.column(0)], pa.binary())})

    packed = told.select(record(date).alias("record")).mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


# --- reading -------------------------------------------------------------------------------------


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at ``at`` and where it ends; ValueError says which check failed."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", at)  # urls make headers of any length
    if head_end < 0:
        raise ValueError("header has no end")
    if data.find(b"\r\nWARC/", at, head_end) >= 0:
        raise ValueError("header runs into another")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        key = name.strip().lower().decode("latin-1")
        if key in fields and key in ("warc-type", "warc-record-id", "content-length"):
            raise ValueError(f"{key} is repeated: the header runs into another")
        fields[key] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no content length")
    begin = head_end + 4
    end = begin + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record doesn't end where its length says")
    block = data[begin:end]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != _b32(block):
        raise ValueError("block digest differs")
    kind = fields.get("warc-type", "")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    told = fields.get("warc-payload-digest", "")
    if kind != "revisit" and told.startswith("sha1:") and told[5:] != _b32(payload):
        raise ValueError("payload digest differs")
    of = (lambda name: m[1] if (m := re.search(r"<([^>]*)>", fields.get(name, ""))) else None)
    length = fields.get("x-payload-length", "")
    return {
        "record_type": kind,
        "record_id": of("warc-record-id"),
        "refers_to": of("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else len(payload),
        "payload_digest": told[5:] if told.startswith("sha1:") else _b32(payload),
        "payload": None if kind == "revisit" else payload,
    }, end + 4


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at``, inflated, and where it ends."""
    inflate, parts, view = zlib.decompressobj(31), [], memoryview(data)
    end = at
    try:
        while not inflate.eof and end < len(data):
            parts.append(inflate.decompress(view[end : end + 65_536]))
            end = min(len(data), end + 65_536)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not inflate.eof:
        raise ValueError("gzip member is cut short")
    return b"".join(parts), end - len(inflate.unused_data)


def goes_on(inner: bytes) -> bool:
    """Whether the record that ``inner`` begins with needs more bytes, for its header or for the length told there."""
    head_end = inner.find(b"\r\n\r\n")
    if head_end < 0:
        return inner.startswith(b"WARC/")
    told = re.match(rb"WARC/.*?\r\nContent-Length: *(\d+)\r\n", inner[: head_end + 2], re.S | re.I)
    return told is not None and len(inner) < head_end + 4 + int(told[1]) + 4


def zipped_records(data: bytes, at: int) -> tuple[list[tuple[int, int, dict | str]], int]:
    """(place in the inflated bytes, length there, record or problem) of all that the gzip member at ``at`` holds, and where
    it ends; a record larger than a member goes on in the next ones."""
    inner, end = member(data, at)
    while data[end : end + 3] == b"\x1f\x8b\x08" and goes_on(inner):
        more, end = member(data, end)
        if more.startswith(b"WARC/"):
            raise ValueError("record goes on but the next member begins another")
        inner += more
    found = list(plain_records(inner))
    if not any(isinstance(x, dict) for _, _, x in found):
        raise ValueError(found[0][2] if found else "gzip member is empty")
    return found, end


def plain_records(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(at, length, record or problem) of inflated bytes: after a failed check it goes on at the next version line."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            found, end = parse_record(data, at)
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            ahead = data.find(b"WARC/", at + 1)
            at = ahead if ahead >= 0 else len(data)
            continue
        if lost is not None:
            yield lost, at - lost, why
            lost = None
        yield at, end - at, found
        at = end
    if lost is not None:
        yield lost, len(data) - lost, why


def salvage(data: bytes) -> Iterator[tuple[int, int, int | None, dict | str]]:
    """(at, length, inner, record) for every valid record of an archive and (at, length, inner, problem) for every gap.

    Takes plain archives and those of gzip members.  ``inner`` is null for plain records and for gaps of archive bytes; else
    it is the place in the inflated bytes of the member at ``at``, of which ``length`` bytes are meant where it is a gap.
    """
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                found, end = zipped_records(data, at)
            else:
                record, end = parse_record(data, at)
                found = [(None, end - at, record)]
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            ahead = [x for x in (data.find(b"WARC/", at + 1), data.find(b"\x1f\x8b\x08", at + 1)) if x >= 0]
            at = min(ahead, default=len(data))
            continue
        if lost is not None:
            yield lost, at - lost, None, why
            lost = None
        for inner, n, x in found:
            yield at, end - at if isinstance(x, dict) else n, inner, x
        at = end
    if lost is not None:
        yield lost, len(data) - lost, None, why


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``problem`` not null) of all archives under ``path``; none where there are no bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RECORDS.split(", "))])
        for b in batches:
            for archive, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                out: list[dict] = []
                for at, n, inner, x in salvage(data.as_py()):
                    row = {"problem": x} if isinstance(x, str) else x if payloads else x | {"payload": None}
                    out.append({"archive": archive, "at": at, "inner": inner, "length": n, **row})
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, RECORDS)


def quarantined(found: DataFrame) -> DataFrame:
    """The log of gaps among the rows of :func:`read_archives`: archive, at, inner, length, problem."""
    return found.where("problem is not null").select("archive", "at", "inner", "length", "problem")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raises where the archives just written have a gap: no page may go missing without a word."""
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    found = written(read_archives(spark, path, payloads=False), "records")
    gaps = quarantined(found)
    if first := gaps.first():
        raise ValueError(f"{gaps.count()} gaps in {path}, such as {first.asDict()}")
    page = (lambda c: F.substring_index(c, ":", -1).try_cast("long"))
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
