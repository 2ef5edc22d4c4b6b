"""The registered query of each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import conversations, hard_negatives, jaccard, licenses, mixing, multi_index, pieces, pii, secrets, segments, topk, toxicity, warc
from daftar.llm.shared import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op3_mix_sources",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS src_null,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents),
    s AS (
      SELECT src, src_null, source_size, 1 + (row_number() OVER (ORDER BY src_null, src) - 1) % 3 AS w,
             3 * source_size AS cap, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY src_null, src) AS rk
      FROM (SELECT src, src_null, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL)),
    l AS (
      SELECT *, row_number() OVER o AS nth, total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
      FROM s WINDOW o AS (ORDER BY cap / w, rk)),
    f AS (SELECT nth AS first_open, rest AS r, ws AS v FROM l WHERE cap * ws >= rest * w ORDER BY nth LIMIT 1),
    t AS (
      SELECT src, src_null, source_size, CASE WHEN nth < first_open THEN CAST(cap AS DOUBLE) ELSE CAST(w * r AS DOUBLE) / CAST(v AS DOUBLE) END AS target
      FROM l, f),
    c AS (
      SELECT d.*, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY src, src_null ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t USING (src, src_null))
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * (CAST(2 * before + size < 2 * target AS BIGINT) + CAST(2 * (before + source_size) + size < 2 * target AS BIGINT)
                + CAST(2 * (before + 2 * source_size) + size < 2 * target AS BIGINT)) AS BIGINT) AS taken
    FROM c""",
)
def mix_sources(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"))
    out = mixed.select(
        "doc.doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("positions")).cast("long").alias("taken"),
        F.try_element_at("positions", F.lit(1)).alias("at"),
    )
    return out.orderBy(F.col("at").asc_nulls_last(), "doc_id").drop("at")


@query("op4_jaccard_join")
def jaccard_join(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"))


def _found_sql(kind: str, nth: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {nth} AS nth, '{kind}' AS kind, CAST(e - len(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e
      FROM (SELECT doc_id, ms[i] AS m, gs[i] AS g,
                   list_sum(list_transform(ps[1:i], lambda x: len(x))) + list_sum(list_transform(ms[1:i], lambda x: len(x))) AS e
            FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {group}) AS gs,
                         string_split_regex(t, '{quoted}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS u(i))
      WHERE len(g) >= {least}"""


@query(
    "op6_scan_secrets",
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS ("
    + " UNION ALL ".join(_found_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))
    + """), g AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans
      FROM h GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)""",
)
def scan_secrets(spark, sf):
    blobs = secrets.versions(table(spark, sf, "documents").select("doc_id", "text"))
    # two states of the store: one that held part of the texts, scanned into a ledger, and the present
    # one with all of them, of which only what that ledger lacks is scanned
    texts = blobs.select("blob", "body")
    earlier = stage(secrets.new_entries(secrets.unseen(texts.filter(F.xxhash64("blob") < 0), None)), "secret-ledger")
    ledger = earlier.union(stage(secrets.new_entries(secrets.unseen(texts, earlier)), "secret-ledger"))
    paths = blobs.select("doc.doc_id", "blob")
    spans = secrets.spans_text(F.col("spans"))
    found = secrets.findings_by_path(paths, ledger)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


def piece_model() -> str:
    """The model file of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def sentencepiece_round_trip(spark, sf):
    return pieces.round_trip(table(spark, sf, "documents"), pieces.load(piece_model()))


@query("op10_warc")
def warc_round_trip(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query(
    "op5_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_multi_index")
def multi_index_duplicates(spark, sf):
    return multi_index.near_duplicates(table(spark, sf, "embeddings"))


@query("op8_pii")
def personal_data(spark, sf):
    return pii.find(table(spark, sf, "documents"))


@query("op2_language")
def language(spark, sf):
    return segments.identify(table(spark, sf, "documents"), list(pieces.load(piece_model()).pieces))


@query("op1_toxicity")
def toxic(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_license_templates", licenses.find_sql())
def license_templates(spark, sf):
    return licenses.find(table(spark, sf, "documents"))


@query("op13_conversation_repair", conversations.REPAIR_SQL)
def conversation_repair(spark, sf):
    rows = conversations.damaged(table(spark, sf, "conversations"))
    return conversations.repair(rows, F.col("gone"))


@query("op11_hard_negatives", hard_negatives.MINE_SQL)
def mined_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), label, F.col("vec_id") % 100 == 0)
