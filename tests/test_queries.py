"""Every registered query against its SQL on the smallest tables, and plan checks."""

import pytest
from check_queries import compare, connect

from __spark_entry__ import SMOKE_DIR, entry
from daftar.plans import tables as D
from daftar.operators.mapping import map_fuzzy
from daftar.plans.catalog import CHECKS, QUERIES, _names


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SMOKE_DIR), con, CHECKS[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 1473


def test_every_order_has_a_header(spark, con):
    n, empty = con.sql("SELECT count(*), count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) FROM orders").fetchall()[0]
    assert empty > 0 and QUERIES["extract_headers_every_order"](spark, SMOKE_DIR).count() == n


def test_coverage_is_of_every_order_and_field(spark, con):
    from daftar.operators.headers import HEADER_FIELDS

    found = QUERIES["extraction_coverage"](spark, SMOKE_DIR)
    assert {f"{c}_rate" for c in HEADER_FIELDS} - {"doc_id_rate", "confidence_rate", "warnings_rate"} <= set(found.columns)
    n, blank = con.sql("SELECT count(*), count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 2 = 0) FROM orders").fetchall()[0]
    assert 0 < blank < n and sorted(r.n_docs for r in found.where("year IS NULL").collect()) == [blank, n]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    if name.startswith("stream_") or name in ("scan_ocr_json", "write_tables"):
        pytest.skip("runs while it is built")
    text = plan(QUERIES[name](spark, SMOKE_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_headers_exchange_lines_once(spark):
    text = plan(QUERIES["extract_headers"](spark, SMOKE_DIR))
    # orders/lineitem make the input; lines themselves are grouped by document only once
    assert text.count("Exchange hashpartitioning(doc_id") == 1


def test_scan_is_pruned(spark):
    text = plan(D.purchase_lines(spark, SMOKE_DIR))
    assert "l_tax" not in text and "p_brand" not in text


def test_fuzzy_meets_on_keys(spark):
    assert "key#" in plan(map_fuzzy(_names(spark, SMOKE_DIR), D.mappings(spark, SMOKE_DIR)))


def test_the_main_path_reaches_both_statuses(spark):
    rows = QUERIES["extract_and_validate_every_order"](spark, SMOKE_DIR).groupBy("status").count().collect()
    found = {r.status: r["count"] for r in rows}
    assert set(found) == {"READY", "NEEDS_REVIEW"} and min(found.values()) > 50 and sum(found.values()) == 1500


def test_a_scan_of_uploads_reads_no_content(spark, tmp_path):
    from daftar.sources.uploads import accepted_uploads, scan_uploads

    for name, size in (("a.PDF", 10), ("b.png", 30), ("c.txt", 5), ("in/d.jpeg", 7), ("noend", 1)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    files = scan_uploads(spark, str(tmp_path))
    assert "content" not in plan(files)
    got = {(r.file_name, r.mime_type, r.size_bytes) for r in accepted_uploads(files).collect()}
    assert got == {("a.PDF", "application/pdf", 10), ("b.png", "image/png", 30), ("d.jpeg", "image/jpeg", 7)}
    assert files.count() == 5


def test_responses_are_kept_compressed(spark, tmp_path, monkeypatch):
    from daftar.plans import catalog

    monkeypatch.setattr(catalog.jobs, "work_folder", lambda spark, name: str(tmp_path / name))
    for name, folder in (("scan_ocr_json", "ocr-json"), ("rejected_results", "ocr-cut"), ("ocr_result_summary", "ocr-full")):
        assert len(QUERIES[name](spark, SMOKE_DIR).collect()) > 1000
        files = [f for f in (tmp_path / folder).iterdir() if f.name.startswith("part-")]
        assert files and all(f.name.endswith(".gz") for f in files)
