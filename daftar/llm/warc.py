"""WARC archives written and read as chunk rows.

A payload travels as rows of record, chunk number and at most ``CHUNK`` bytes, cut on the
JVM side from the payload's bytes, so no task outside the input row itself ever holds a
whole record. Digests are carried along from chunk to chunk. The writer puts chunks straight
into a compressed stream, the reader gives chunks back the same way.

Equal payloads are stored once: the record with the largest identifier is the response, the
others refer to it. Files get names of their own per attempt, and a table of the files of
finished tasks says which ones count, so a task that is run again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm.shared import new_folder, small_batches, stage

CHUNK = 256 * 1024
BATCH_ROWS = 64  # so that a batch of full chunks stays at 16 MB
FILE_BYTES = 64 << 20  # a file is closed once it has grown to this
EMPTY_LINE = b"\r\n"
URN = "urn:x-page:"


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``body`` (bytes), ``sha1`` (hex), ``refers_to``: null for responses.

    A null payload is empty. Payloads shorter than ``min_bytes`` refer to nothing. Rows that
    share the largest page_id of a payload are all responses; a null page_id is smaller than
    any other and a response if a payload has no other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"),
    ).withColumn("sha1", F.sha1("body"))
    newest = rows.groupBy("sha1").agg(F.max("page_id").alias("newest"))
    other = (F.length("body") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(newest, "sha1").withColumn("refers_to", F.when(other, F.col("newest"))).drop("newest")


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """Records as rows of at most ``size`` bytes: identifier, what the header needs, ``chunk_no``, ``last``, ``data``.

    Revisits carry no payload, only its length and digest. An empty payload is one empty chunk.
    """
    kept = F.when(F.col("refers_to").isNull(), F.col("body"))
    n = F.greatest(F.ceil(F.coalesce(F.length(kept), F.lit(0)) / size), F.lit(1)).cast("int")
    numbered = records.select(
        "page_id", "url", "sha1", "refers_to", F.length("body").cast("long").alias("payload_bytes"), n.alias("n"),
        kept.alias("body"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"),
    )
    return numbered.select(
        "page_id", "url", "sha1", "refers_to", "payload_bytes", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"),
        F.coalesce(F.substring("body", F.col("chunk_no") * size + 1, F.lit(size)), F.lit(b"")).alias("data"),
    )


def _header(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    name = lambda i: f"<{URN}{'' if i is None else i}>"
    revisit = row["refers_to"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(row["page_id"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")),
        ("WARC-Payload-Digest", "sha1:" + _b32(bytes.fromhex(row["sha1"]))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else row["payload_bytes"]))),
    ]
    if revisit:
        fields.insert(2, ("WARC-Refers-To", name(row["refers_to"])))
        fields.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + EMPTY_LINE + http


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out = member = path = None
        records, state = 0, hashlib.sha1()

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None:
                        path, records = f"{base}/{uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    member, state = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0), hashlib.sha1()
                    member.write(_header(row, date))
                member.write(row["data"])
                state.update(row["data"])
                if row["last"]:
                    if row["refers_to"] is None and state.hexdigest() != row["sha1"]:
                        raise ValueError(f"payload of {row['page_id']} changed on its way")
                    member.write(EMPTY_LINE * 2)
                    member.close()
                    records += 1
                    if out.tell() >= FILE_BYTES:
                        yield finished()
                        out = None
        if out is not None:
            yield finished()

    return run


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", size: int = CHUNK) -> DataFrame:
    """Write records to compressed WARC files in ``folder`` (shared storage) and return the table of files: ``path``, ``records``."""
    spark = records.sparkSession
    small_batches(spark, BATCH_ROWS)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return stage(chunks(records, size).mapInArrow(_writer(folder, date), "path string, records long"), "warc-files")


CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "surrogatepass").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _block(stream) -> list[bytes]:
    lines = []
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        lines.append(line)
    return lines


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits else None


def record_chunks(stream, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` from an uncompressed WARC stream, one chunk in memory at a time."""
    while first := stream.readline():
        if not first.strip():
            continue  # the two empty lines that end a record
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = _fields(_block(stream))
        left = int(head["content-length"])
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            while left:
                left -= len(stream.read(min(size, left)))
            continue
        http = _block(stream)
        left -= sum(len(line) + 2 for line in http) + 2
        declared = int(_fields(http[1:])["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        state, done, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(size, left))
            if left and not data:
                raise EOFError("a record ends early")
            left -= len(data)
            done += len(data)
            state.update(data)
            so_far = _b32(state.digest())
            if not left and kind == "response" and (so_far != digest or done != declared):
                raise ValueError(f"record {head['warc-record-id']} is damaged")
            yield (_number(head["warc-record-id"]), kind, _number(head.get("warc-refers-to")), number, data, done, so_far, not left, declared, digest)
            number += 1
            if not left:
                break


def _reader(folder: str, size: int):
    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()),
        ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows, held = [], 0
                    for row in record_chunks(stream, size):
                        rows.append(row)
                        held += len(row[4])
                        if held >= BATCH_ROWS * CHUNK or len(rows) >= 1000:
                            yield as_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows)

    return run


def read_archives(files: DataFrame, folder: str, size: int = CHUNK) -> DataFrame:
    """The chunk table (``CHUNKS``) of all archives named in ``files``, one file a task at a time."""
    n = max(1, files.count())
    spread = files.select("path").repartition(min(n, 10_000), F.xxhash64("path"))
    return spread.mapInArrow(_reader(folder, size), CHUNKS)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC and read them back, one row per page.

    Returned are ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``. Every row is a record, repeated rows and null ids included; an empty table
    gives no archive and no rows. Columns other than the three are not looked at.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    table = read_archives(write_archives(with_originals(pages, min_bytes), folder), folder)
    whole = table.filter("last")
    response = F.col("record_type") == "response"
    return whole.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
