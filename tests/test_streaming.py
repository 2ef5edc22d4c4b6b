import json

from pyspark.sql import functions as F
from samples import RECEIPT_1, RECEIPT_2

from daftar.sources.snapshots import Snapshot
from daftar.streaming import jobs


def event_files(spark, folder, *batches):
    """Each batch becomes one file, in order of modification."""
    import os

    for n, rows in enumerate(batches):
        path = folder / f"{n}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("upload_id", "seq", "ts", "status", "error_code"), r))) for r in rows), encoding="utf8")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    schema = "upload_id string, seq long, ts timestamp, status string, error_code string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def t(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_status_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = event_files(
        spark, tmp_path / "in",
        [("a", 1, t(0), "QUEUED", None), ("a", 1, t(0), "QUEUED", None), ("b", 2, t(1), "READY", None)],
        [("a", 3, t(10), "READY", None), ("a", 1, t(0), "QUEUED", None)],
        [("a", 4, t(5), "PROCESSING_OCR", None)],  # arrives after a later event
    )
    out = str(tmp_path / "out")
    jobs.stream_status(events, out, str(tmp_path / "mark")).awaitTermination()
    got = {r.upload_id: (r.status, r.n_events) for r in jobs.read_status(spark, out).collect()}
    assert got == {"a": ("READY", 3), "b": ("READY", 1)}


def test_late_errors_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    err = "OCR_TIMEOUT"
    events = event_files(
        spark, tmp_path / "in",
        [("a", 1, t(10), "OCR_FAILED", err), ("a", 2, t(20), "READY", None), ("b", 3, t(200), "OCR_FAILED", err)],
        [("c", 5, t(190), "OCR_FAILED", err)],
        # over an hour behind what two batches ago had reached
        [("c", 4, t(30), "OCR_FAILED", err), ("d", 6, t(500), "OCR_FAILED", err)],
        [("d", 7, t(501), "OCR_FAILED", err)],
    )
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.stream_error_rate(events), out, str(tmp_path / "mark"))
    got = {(r.window_start.hour, r.error_code): r.n for r in spark.read.parquet(out).collect()}
    assert got == {(0, err): 1, (3, err): 2}  # the window still open is not out yet


def test_one_job_per_upload(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = event_files(spark, tmp_path / "in", [("a", 1, t(0), "QUEUED", None), ("b", 2, t(1), "QUEUED", None)], [("a", 3, t(2), "QUEUED", None)])
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.stream_jobs(events), out, str(tmp_path / "mark"))
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == ["ocr:a", "ocr:b"]


def test_documents(spark, tmp_path):
    box = {"x1": 0, "y1": 0, "x2": 9, "y2": 9}

    def put(name, texts):
        lines = [{"text": x, "confidence": 0.9, "box": {**box, "y1": 30 * i, "y2": 30 * i + 9}} for i, x in enumerate(texts)]
        doc = {"doc_id": name, "pages": [{"pageNumber": 1, "lines": lines}]}
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc), encoding="utf8")

    (tmp_path / "in").mkdir()
    run = lambda: jobs.stream_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), "text_only").awaitTermination()
    put("r1", RECEIPT_1)
    run()
    put("r2", RECEIPT_2)
    put("again", RECEIPT_1)
    run()
    assert spark.read.parquet(str(tmp_path / "out" / "extractions")).count() == 3
    verdicts = {r.upload_id: r for r in spark.read.parquet(str(tmp_path / "out" / "verdicts")).collect()}
    # the second copy of the first receipt meets the stored one
    assert {k: v.n_errors for k, v in verdicts.items()} == {"r1": 0, "r2": 0, "again": 1}
    items = spark.read.parquet(str(tmp_path / "out" / "lines")).groupBy("extraction_id").agg(F.sum("line_total").alias("s"))
    assert {r.extraction_id: float(r.s) for r in items.collect()} == {"ex-r1": 86.96, "ex-r2": 43.47, "ex-again": 86.96}


def test_status_state_expires_and_late_events_meet_the_snapshot(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = event_files(
        spark, tmp_path / "in",
        [(f"u{i}", i, t(0), "QUEUED", None) for i in range(500)] + [("a", 900, t(1), "READY", None)],
        [("b", 1000, t(300), "QUEUED", None)],
        [("c", 1001, t(600), "QUEUED", None)],
        # upload a has long expired: within the lateness, older than the stored status, newer than it
        [("a", 1003, t(610), "PROCESSING_OCR", None), ("u7", 1005, t(560), "OCR_FAILED", None), ("a", 1003, t(610), "PROCESSING_OCR", None)],
        [("a", 901, t(2), "OCR_FAILED", None), ("a", 900, t(1), "READY", None)],  # behind the watermark: dropped
    )
    out = str(tmp_path / "out")
    query = jobs.stream_status(events, out, str(tmp_path / "mark"), buckets=8)
    query.awaitTermination()
    got = {r.upload_id: (r.status, r.n_events) for r in jobs.read_status(spark, out, 8).collect()}
    assert len(got) == 503 and got["a"] == ("PROCESSING_OCR", 2) and got["u7"] == ("OCR_FAILED", 2) and got["u8"] == ("QUEUED", 1)
    kept = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert kept[0]["numRowsTotal"] == 501 and kept[-1]["numRowsTotal"] <= 4
    assert sum(k["numRowsDroppedByWatermark"] for k in kept) == 2


def snapshot(path, buckets=16):
    return Snapshot(str(path), "k string, n long", ("k",), buckets)


def test_snapshot_batches_can_run_again(spark, tmp_path):
    store, total = snapshot(tmp_path / "s"), [F.sum("n").alias("n")]
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    read = lambda: {r.k: r.n for r in store.read(spark).collect()}
    assert read() == {} and store.latest(spark) is None
    store.merge(rows(("a", 1), ("b", 2), ("a", 3)), 0, total)
    store.merge(rows(("a", 10), ("c", 5), (None, 7)), 1, total)
    want = {"a": 14, "b": 2, "c": 5, None: 7}
    assert read() == want
    store.merge(rows(("a", 10), ("c", 5), (None, 7)), 1, total)  # the same batch again
    assert read() == want
    # a batch that stopped before its manifest is not seen, and its data are replaced when it runs again
    rows(("a", 1000)).withColumn("_bucket", store.bucket()).write.partitionBy("_bucket").parquet(str(tmp_path / "s" / "data" / "batch=2"))
    assert read() == want
    store.merge(rows(("b", 1)), 2, total)
    assert read() == want | {"b": 3}
    assert {r.k: r.n for r in store.read(spark, 0).collect()} == {"a": 4, "b": 2}
    store.merge(rows(), 3, total)
    store.vacuum(spark, keep=1)
    assert read() == want | {"b": 3}
    left = {p.name for p in (tmp_path / "s" / "manifest").iterdir()}
    assert left == {"batch=3"}


def read_bytes(spark, df):
    """Bytes of the files that a query opens."""
    import os

    return sum(os.path.getsize(f.removeprefix("file://").replace("%3D", "=")) for f in df.inputFiles())


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path):
    """What a batch reads of the index does not grow with invoices stored in other buckets."""
    store, first = snapshot(tmp_path / "s", 64), [F.min("n").alias("n")]
    batch = spark.createDataFrame([("v1", 1), ("v2", 2)], "k string, n long")
    mine, sizes = store.touched(batch), []
    store.merge(batch, 0, first)
    for n in (1, 2, 3):
        history = spark.range(5000 * n).select(F.concat(F.lit(f"h{n}-"), "id").alias("k"), F.col("id").alias("n"))
        history = history.where(~store.bucket().isin(list(mine)))
        store.merge(history, n, first)
        sizes.append(read_bytes(spark, store.read(spark, only=mine)))
        assert read_bytes(spark, store.read(spark)) > 20 * sizes[-1]
    assert len(set(sizes)) == 1 and len(mine) <= 2


def test_documents_give_the_verdicts_of_the_batch_job(spark, tmp_path):
    """Several micro-batches, one of them run twice, against validation of everything at once."""
    from daftar.operators.validate import validate_invoices

    box = {"x1": 0, "y1": 0, "x2": 9, "y2": 9}
    (tmp_path / "in").mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def put(name, texts):
        lines = [{"text": x, "confidence": 0.9, "box": {**box, "y1": 30 * i, "y2": 30 * i + 9}} for i, x in enumerate(texts)]
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"doc_id": name, "pages": [{"pageNumber": 1, "lines": lines}]}), encoding="utf8")

    names = [(f"d{i}", RECEIPT_1 if i % 2 else RECEIPT_2) for i in range(6)] + [("empty", [])]
    mapped = spark.createDataFrame(
        [("m1", None, "x", "p1")], "mapping_id string, supplier_id string, normalized_name string, product_id string"
    )
    for at in (0, 2, 4):
        for name, texts in names[at : at + 2 if at < 4 else None]:
            put(name, texts)
        jobs.stream_documents(spark, str(tmp_path / "in"), out, mark, "text_only", mapped).awaitTermination()
        if at == 2:  # as after a stop before the batch was marked as done
            commits = tmp_path / "mark" / "commits"
            for f in [commits / "1", commits / ".1.crc"]:
                f.unlink(missing_ok=True)
    read = lambda name: spark.read.parquet(f"{out}/{name}").drop("batch")
    assert read("extractions").count() == 7 and read("documents").count() == 7
    columns = ["extraction_id", "n_errors", "n_warnings", "status"]
    whole = validate_invoices(read("extractions"), read("lines"), "arrival").select(*columns)
    assert sorted(map(tuple, read("verdicts").select(*columns).collect())) == sorted(map(tuple, whole.collect()))
    assert sum(r.n_errors for r in read("verdicts").collect() if r.upload_id != "empty") == 4
    assert jobs.first_seen(out).read(spark).count() == 2
