"""WARC archives: writing, reading, and revisit resolution.

Headers (no payload) are shuffled by payload digest to find, for each group of equal payloads of at
least ``least_bytes``, the record that stays a response; the others become revisits, and archives
are written with fresh headers.  Payloads stay where they are: responses are written by the task
that scans them, and revisits, which have no payload, from their headers.  Which pages are
responses the scan is told by two bitmaps: one of the revisits, and one of those responses that
the first holds by chance.  Only pages in both (next to none while the bitmaps are not full) go
through an exchange with their payload, to be told by a join.

Each record is a gzip member of its own, and an archive is one row of at most ``archive_bytes`` (or a
single larger record), so archives are bounded by bytes.  Spark's text writer puts them on any store
that Spark can write to: the last byte of a gzip member is the high byte of its content's length,
0 below 16 MB, so members are written without it and joined by NUL as line separator; a larger
record ends with a small member of its own.  Revisits name the record, URI and date they refer to by
the standard headers (WARC-Refers-To, -Target-URI, -Date), by which reading resolves them.

Defined cases: a null payload is the empty one; a null target is a record without WARC-Target-URI;
a null id is written as a record without the page's id, is read back as null, and stays a response, as
nothing could tell it from others.  Repeated rows (same id, same payload) are alike: if theirs is
the largest id of the group, all are responses, else all are revisits.  Empty tables give empty
archives and results.  Further columns are ignored.
A very long payload is held whole by the task that scans it, and by no exchange.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .bitmap import build_bitmap, held
from .storage import new_path, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, record_id string, target string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, intact boolean"
ARCHIVE_BYTES = 16 << 20
#: Content of a gzip member: its length's high byte must be 0.
MOST_MEMBER = 8 << 20
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def decide(captures: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Headers (``page_id, url, payload_bytes, payload_digest``) with ``refers_to``, ``refers_to_url`` and ``record_type``.

    Groups are reduced to (largest id, its URL, count) by digest before they are joined back, so a payload
    held by a third of all pages costs one row a task in the exchange and a splittable join.
    """
    large = captures.where(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = captures.join(groups, ["payload_digest", "payload_bytes"], "left")
    is_revisit = F.coalesce(F.col("page_id") != F.col("original.page_id"), F.lit(False))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.when(is_revisit, F.col("original.page_id")).alias("refers_to"), F.when(is_revisit, F.col("original.url")).alias("refers_to_url"),
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
    )


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    """The same for the same page, payload and kind, so that revisits can name a record that another task writes."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}/{kind}'.encode()).digest()[:16], version=5)}>"


def _one_line(text: str) -> str:
    return text.replace("\r", " ").replace("\n", " ")


def record(page_id: int | None, url: str | None, digest: str, date: str, payload: bytes | None, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One record, a response (``payload``) or a revisit of page ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response"))]
        if refers_to_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _one_line(refers_to_url)))
        fields.append(("WARC-Refers-To-Date", date))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("Content-Length", str(len(payload or b""))))
    return b"".join([b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8"), b"\r\n", payload or b"", b"\r\n\r\n"])


def members(content: bytes) -> list[bytes]:
    """``content`` as gzip members, without the last byte (0) of each."""
    cuts = [*range(0, len(content), MOST_MEMBER), len(content)]
    return [_member(content[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (packer.compress(content) + packer.flush())[:-1]


def _archives(records: Iterator[bytes], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([b"\0".join(parts)], pa.binary())], ["value"])
    for one in records:
        packed = members(one)
        own = sum(map(len, packed)) + len(packed)
        if parts and size + own > archive_bytes:
            yield row()
            parts, size = [], 0
        parts += packed
        size += own
    if parts:
        yield row()


def _key(page_id: str, digest: str):
    return F.xxhash64(page_id, digest)


def write_archives(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Write ``pages`` as deduplicated archives (a gzip member a record) under ``path``; ``date`` is the records' date, else now."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), F.coalesce(pages[payload_column], F.lit("")).alias("payload")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    headers = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    decided = stored(decide(headers, least_bytes), "warc-headers")
    revisits, responses = (decided.where(F.col("record_type") == kind) for kind in ("revisit", "response"))
    n, bits = revisits.count(), LEAST_BITS
    while bits < MOST_BITS and bits < 32 * n:
        bits *= 2
    first = spark.sparkContext.broadcast(build_bitmap(revisits.select(_key("page_id", "payload_digest").alias("key")), bits))

    def by_chance(batches):
        for batch in batches:
            keys = batch.column(0)
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(held(first.value, kernel.ints(keys))))], ["key"])

    second = spark.sparkContext.broadcast(build_bitmap(responses.select(_key("page_id", "payload_digest").alias("key")).mapInArrow(by_chance, "key long"), bits))

    def responses_of(batch: pa.RecordBatch, keep) -> Iterator[bytes]:
        ids, urls, digests, payloads = (batch.column(c) for c in ("page_id", "url", "payload_digest", "payload"))
        for k in keep:
            yield record(ids[k].as_py(), urls[k].as_py(), digests[k].as_py(), date, payloads[k].as_py().encode("utf-8"))

    def sure(batches):
        """Pages that the first bitmap does not hold are responses."""
        yield from _archives((one for batch in batches for one in responses_of(batch, (~held(first.value, kernel.ints(batch.column("key")))).nonzero()[0].tolist())), archive_bytes)

    def open_(batches):
        """Pages that both hold; those that only the first holds are revisits."""
        for batch in batches:
            keys = kernel.ints(batch.column("key"))
            yield batch.filter(pa.array(held(first.value, keys) & held(second.value, keys))).drop_columns(["key"])

    def joined(batches):
        yield from _archives((one for batch in batches for one in responses_of(batch, range(batch.num_rows))), archive_bytes)

    def again(batches):
        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    yield record(r["page_id"], r["url"], r["payload_digest"], date, None, r["refers_to"], r["refers_to_url"])

        yield from _archives(records(), archive_bytes)

    keyed = rows.withColumn("key", _key("page_id", "payload_digest"))
    doubtful = keyed.mapInArrow(open_, rows.schema)
    known = revisits.select("page_id", "payload_digest").distinct()
    parts = [keyed.mapInArrow(sure, "value binary"), doubtful.join(known, ["page_id", "payload_digest"], "left_anti").select(*rows.columns).mapInArrow(joined, "value binary")]
    parts.append(revisits.select("page_id", "url", "payload_digest", "refers_to", "refers_to_url").mapInArrow(again, "value binary"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of one archive, in order, from its decompressed bytes."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        while True:
            stop = buffer.find(b"\r\n\r\n")
            if stop < 0:
                break
            lines = buffer[:stop].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record where one should begin")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            if len(buffer) < stop + 8 + size:
                break
            payload = bytes(buffer[stop + 4 : stop + 4 + size])
            del buffer[: stop + 8 + size]
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            yield {
                "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "record_id": fields["WARC-Record-ID"], "target": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest,
                "payload_bytes": size if kind == "response" else None, "refers_to": fields.get("WARC-Refers-To"), "payload": payload if kind == "response" else None,
                "intact": kind == "revisit" or hashlib.sha1(payload).hexdigest() == digest,
            }
    if buffer:
        raise ValueError("an archive ends inside a record")


def unpacked(data: pa.Buffer, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a run of gzip members, piece by piece; a member's end is looked for in ``step`` bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a gzip member")
            fed = view[at : at + step]
            yield member.decompress(fed)
            at += len(fed) - len(member.unused_data)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``; ``intact`` says whether a response's payload has its digest.

    ``payloads=False`` leaves payloads behind in the reading task (they are still checked).
    """
    fields = T.StructType.fromDDL(RECORD_SCHEMA)
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in RECORD_SCHEMA.split(", "))])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                chunk, size = [], 0
                for one in parse_records(unpacked(content.as_buffer())):
                    size += len(one["payload"] or b"")
                    if not payloads:
                        one["payload"] = None
                    chunk.append(one)
                    if size > 8 << 20 or len(chunk) >= 5000:
                        yield pa.RecordBatch.from_pylist(chunk, schema)
                        chunk, size = [], 0
                if chunk:
                    yield pa.RecordBatch.from_pylist(chunk, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(parse, fields)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join each revisit to the record that its WARC-Refers-To names; ``payload_bytes`` is the length of the original.

    Fails a revisit (``resolved`` false) whose original is missing or has another digest.
    """
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "resolved")
    responses = records.where("record_type = 'response'")
    originals = responses.where("page_id is not null").groupBy("record_id").agg(F.max(F.struct("page_id", "payload_digest", "payload_bytes", "intact")).alias("original"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", F.col("refers_to").alias("record_id"))
    answered = revisits.join(originals, "record_id", "left").withColumn("resolved", F.coalesce(F.col("original.intact") & (F.col("original.payload_digest") == F.col("payload_digest")), F.lit(False)))
    found = answered.select("page_id", F.col("original.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original.page_id").alias("refers_to"), "resolved")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("intact").alias("resolved")).unionByName(found).select(*columns)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives, then read them back and resolve their revisits."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # Records without payloads are stored once, so that the archives are read once and not for either side of the join.
    return resolve_revisits(stored(read_archives(spark, path, payloads=False), "warc-records"))


ORACLE_SQL = """
WITH captures AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), chosen AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM captures
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to,
       true AS resolved
FROM chosen
"""
