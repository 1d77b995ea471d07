"""WARC archives through a chunked record table.

Payloads travel as (record, chunk number, bytes) rows of at most ``CHUNK`` bytes, cut by the JVM, so Python never holds a whole
record: the writer streams chunks into one gzip member a record, the reader inflates and parses a file in steps of ``CHUNK`` bytes and
gives back chunk rows that carry the running SHA-1 of the payload so far. The last chunk's digest is the payload's.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is the response and the others revisit
it. Equal payloads are found on (digest, id) rows alone. Where the revisits found are few by count, they are broadcast and html is not shuffled; else
html is dealt by id, so a payload that a third of the pages share makes no large task.

Each attempt of a task writes files of its own name; the table of files lists those of committed attempts only, so a lost executor leaves at
most unread files. Files go to a URI that pyarrow's file systems open.

Defined results: a null payload is empty; a null url gives a record without target; repeated rows with the largest id are responses each; rows with
a null id get a record without number and never serve as the response of others; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import new_path, written

CHUNK, FILE_BYTES, LEVEL = 1 << 16, 1 << 28, 3
#: Revisits (64 bytes each) that may be broadcast; more are joined by a shuffle of the pages.
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = "record string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, data binary, running_sha1 string, last boolean"


def chunk_table(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, bytes, sha1, record_type, refers_to, chunk, data, last); revisits have one empty chunk."""
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("body"))
    base = base.withColumns({"bytes": F.octet_length("body").cast("long"), "sha1": F.sha1("body")})
    digests = base.select("page_id", "sha1").where(F.col("page_id").isNotNull() & (F.col("bytes") >= least)).distinct()
    newest = digests.groupBy("sha1").agg(F.max("page_id").alias("newest"))
    revisits = digests.join(newest, "sha1").where("page_id <> newest").select(F.col("page_id").alias("__k"), F.col("sha1").alias("__s"), "newest")
    revisits = written(revisits, "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = base.join(revisits, (F.col("page_id") == F.col("__k")) & (F.col("sha1") == F.col("__s")), "left")
    rows = rows.withColumn("body", F.when(F.col("newest").isNull(), F.col("body")).otherwise(F.lit(b"")))
    rows = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0, cast(greatest(0L, octet_length(body) - 1L) div {chunk} as int))")))
    return rows.select(
        "page_id", "url", "bytes", "sha1",
        F.when(F.col("newest").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("newest").alias("refers_to"), "chunk",
        F.expr(f"substring(body, chunk * {chunk} + 1, {chunk})").alias("data"), F.expr(f"(chunk + 1L) * {chunk} >= octet_length(body)").alias("last"),
    )


def _header(page_id, url, size, sha1, kind, refers_to, stored) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"X-Payload-Length: {size}", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {stored}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Stream chunk rows into gzipped archives under ``folder`` (a URI); the committed table (path, records)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        prefix = folder.rstrip("/")
        out, path, records, size, done = None, "", 0, 0, []
        member, running = None, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, records))
                out = None

        for b in (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64)):
            for page_id, url, whole, sha1, kind, refers_to, chunk, data, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk == 0:
                    if out is not None and size >= file_bytes:
                        close()
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        path = f"{prefix}/{name}"
                        store.create_dir(root)
                        out = store.open_output_stream(f"{root.rstrip('/')}/{name}")
                    member, running = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    size += out.write(member.compress(_header(page_id, url, whole, sha1, kind, refers_to, 0 if kind == "revisit" else whole)))
                running.update(data)
                size += out.write(member.compress(data))
                if last:
                    if kind != "revisit" and running.hexdigest() != sha1:
                        raise ValueError(f"page {page_id}: the chunks don't add up to the payload")
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return written(chunks.mapInArrow(work, "path string, records long"), "archives")


def _inflated(stream, step: int) -> Iterator[bytes]:
    """The plain bytes of a file of gzip members, at most ``step`` at a time."""
    member = None
    while raw := stream.read(step):
        while raw:
            member = member or zlib.decompressobj(31)
            plain = member.decompress(raw, step)
            raw = member.unconsumed_tail
            if plain:
                yield plain
            if member.eof:
                raw, member = member.unused_data, None


def _records(stream, step: int) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """(headers, chunk number, data, running digest, last) of each chunk of each record."""
    plain, held = _inflated(stream, step), b""
    while True:
        while b"\r\n\r\n" not in held:
            more = next(plain, None)
            if more is None:
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
            held = (held + more).lstrip(b"\r\n") if not held.strip() else held + more
        head, _, held = held.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        left, running, number = int(headers["Content-Length"]), hashlib.sha1(), 0
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        while True:
            while len(held) < min(left, step):
                more = next(plain, None)
                if more is None:
                    raise ValueError("an archive ends inside a payload")
                held += more
            data, held = held[: min(left, step)], held[min(left, step) :]
            left -= len(data)
            running.update(data)
            if not left and headers["WARC-Type"] == "response" and base64.b32encode(running.digest()).decode() != stated:
                raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not have the stated digest")
            yield headers, number, data, running.hexdigest(), left == 0
            number += 1
            if not left:
                break
        held = held.lstrip(b"\r\n")


def read_chunks(spark: SparkSession, archives: DataFrame, with_data: bool = True, step: int = CHUNK) -> DataFrame:
    """The chunk rows (``CHUNK_SCHEMA``) of all records of the archives, a task for every few files; data is null without ``with_data``."""
    schema = spark.createDataFrame([], CHUNK_SCHEMA).schema
    arrow = pa.schema([(n, t) for n, t in zip(schema.names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.bool_()], strict=True)])

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(root) as stream:
                    for h, n, data, digest, last in _records(stream, step):
                        rows.append((h["WARC-Record-ID"], number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], number(h.get("WARC-Refers-To")),
                                     int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), n, data if with_data else None, digest, last))
                        held += len(data)
                        if held > 1 << 22 or len(rows) >= 4000:
                            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    n = max(1, archives.count())
    return archives.select("path").repartition(min(n, 10_000)).mapInArrow(work, schema)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write the records of ``pages``, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    archives = write_archives(chunk_table(pages, key, url, payload, least), folder or new_path(spark, "warc"))
    rows = read_chunks(spark, archives, with_data=False).where("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
