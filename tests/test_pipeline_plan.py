from pyspark.sql import functions as F

from daftar.plans import pipeline
from daftar.plans.rendered import text_invoices
from daftar.operators.assemble import document_markdown


def test_headers_and_items_share_one_exchange_of_lines(spark, tmp_path):
    text_invoices(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    df = pipeline.extract_and_validate(lines, F.lit("2024-01-01").cast("timestamp"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning(doc_id" in x]
    assert sum("ReusedExchange" not in x for x in exchanges) == 1 and sum("ReusedExchange" in x for x in exchanges) == 1
    assert plan.count("FileScan") == 1


def test_markdown_of_a_long_document_in_slices(spark):
    """Joined in slices like in one go: by height, then line; missing heights first, missing texts left out."""
    n = 20_000
    height = F.when(F.col("id") % 50 != 0, (F.col("id") * 7 % n).cast("double"))
    lines = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("line_no"), height.alias("y1"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("t"), "id")).alias("text")
    ).unionByName(spark.createDataFrame([("e", 0, 1.0, None)], "doc_id string, line_no long, y1 double, text string")).repartition(5)
    got = {r.doc_id: r.markdown for r in document_markdown(lines).collect()}
    rows = [(i * 7 % n if i % 50 else -1, i, f"t{i}") for i in range(n) if i % 9]
    assert got == {"d": "\n".join(t for *_, t in sorted(rows)), "e": ""}
