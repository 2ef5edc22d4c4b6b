import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daftar.llm import warc

SCHEMA = "page_id long, url string, html string, last int"


def expected(rows, min_bytes=0):
    newest = defaultdict(lambda: None)
    for i, _, html, *_ in rows:
        if i is not None and (newest[html or ""] is None or i > newest[html or ""]):
            newest[html or ""] = i
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        to = newest[html or ""]
        to = to if len(raw) >= min_bytes and to != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a/", "<p>é</p>", 0), (2, "http://b/ \r\nX: y", "<p>é</p>", 0), (3, None, None, 1), (4, "u", "", 1), (5, "u", "WARC/1.1\r\n\r\n", 1),
    (6, "u", "x" * 700_000, 1), (9, "u", "x" * 700_000, 1), (7, "u", "é" * 300_000, 1), (5, "u", "WARC/1.1\r\n\r\n", 1), (None, "u", "<p>é</p>", 1),
    (None, "u", "alone", 1), (8, "u", "\r\n\r\n", 1),
]


@pytest.mark.parametrize("min_bytes", [0, 9])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert answer(warc.round_trip(df, min_bytes=min_bytes)) == expected(ROWS, min_bytes)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert answer(warc.round_trip(df)) == expected(rows)


def test_chunks_carry_the_payload(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    records = warc.with_originals(df)
    files = warc.write_archives(records, f"file://{tmp_path}", size=1000)
    table = warc.read_archives(files, f"file://{tmp_path}", size=777)
    assert table.agg(F.max(F.length("data"))).first()[0] == 777
    got = {r.page_id: r for r in table.filter("page_id = 7").groupBy("page_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c")).collect()}[7]
    assert got.n == -(-600_000 // 777) and b"".join(x.data for x in got.c).decode() == "é" * 300_000
    lengths = [r.bytes_so_far for r in table.filter("page_id = 7").orderBy("chunk_no").collect()]
    assert lengths == sorted(lengths) and lengths[-1] == 600_000


def test_files_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1)
    files = warc.write_archives(warc.with_originals(df), f"file://{tmp_path}").collect()
    text = b"".join(gzip.open(f.path).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == 2 and text.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://b/%20%0D%0AX:%20y\r\n" in text and sum(f.records for f in files) == 2
    with pytest.raises(ValueError, match="damaged"):
        list(warc.record_chunks(io.BytesIO(text.replace("é".encode(), b"zz"))))
