import hashlib
import random
import re
from collections import defaultdict

import pytest
from check_queries import compare, connect
from pyspark.sql import functions as F

from daftar.llm import mixing, secrets
from daftar.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_and_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), CHECKS[name]) is None


def targets(sizes):
    """Shares by repeated capping, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "z", None, ""]), " w" * rng.randrange(60), i) for i in range(900)] + [(5, "tiny", "x", 0), (None, "a", None, 0), (7, "a", "\t \n", 0), (5, "tiny", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.doc.source] += r.size
        taken[r.doc.source] += r.size * len(r.positions)
        assert r.size == len((r.doc.text or "").split()) and len(r.positions) <= 3 and sorted(r.positions) == r.positions
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.doc.source] and abs(r.target - want[r.doc.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    copies = mixing.mixed_documents(df).collect()
    assert len(copies) == sum(len(r.positions) for r in got) and copies[0].asDict().keys() == {"doc_id", "source", "text", "size"}
    assert mixing.mix(df.limit(0)).collect() == []


def plain(text):
    out = []
    key = r"(?i:password|passwd|secret|token|api_?key)"
    for nth, (kind, pattern, group, least) in enumerate([("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]):
        out += [(m.start(), nth, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(3)
    bits = ["token", "=", ": ", '"', "Api_Key", "password=", "secret:", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "é", "😀", " ", "\n", "x", "hunter22"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "token=abc token=abcdefgh"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "token=abcdefgh", 1)], "doc_id long, text string, blob int")
    blobs = secrets.versions(df)
    ledger = secrets.new_entries(secrets.unseen(blobs.select("blob", "body"), None))
    rows = secrets.findings_by_path(blobs.select("doc.doc_id", "blob"), ledger).withColumn("said", secrets.spans_text(F.col("spans"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "token=abcdefgh" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.said == ",".join(f"{k}:{s}:{e}" for s, _, k, e in plain(text)), text


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([(1, "token=abcdefgh"), (2, "quiet")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "token=abcdefgh"), (3, "secret=12345678")], "doc_id long, text string")
    ledger = secrets.new_entries(secrets.unseen(secrets.versions(old).select("blob", "body"), None))
    pending = secrets.unseen(secrets.versions(new).select("blob", "body"), ledger).collect()
    assert [bytes(r.blob).hex() for r in pending] == [hashlib.sha256(b"secret=12345678").hexdigest()]
    changed = (secrets.RULES[0], secrets.Rule("hex", "2", "[0-9a-f]{8}", "[0-9a-f]+", 0, 8))
    todo = {bytes(r.blob).hex()[:4]: sorted(r.todo) for r in secrets.unseen(secrets.versions(old).select("blob", "body"), ledger, changed).collect()}
    assert len(todo) == 2 and all(t == ["hex@2"] for t in todo.values())


def test_secret_steps_on_empty_tables_and_odd_rows(spark):
    rows = [(None, "token=abcdefgh", 1), (None, "token=abcdefgh", 1), (1, None, 2), (2, "x" * 500_000 + " secret: 12345678", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    empty = secrets.versions(df.limit(0))
    none = secrets.new_entries(secrets.unseen(empty.select("blob", "body"), None))
    assert none.collect() == [] and secrets.findings_by_path(empty.select("doc.doc_id", "blob"), none).collect() == []
    blobs = secrets.versions(df)
    # against an empty ledger as against none
    ledger = secrets.new_entries(secrets.unseen(blobs.select("blob", "body"), none))
    found = secrets.findings_by_path(blobs.select("doc.doc_id", "blob"), ledger).withColumn("said", secrets.spans_text(F.col("spans"))).collect()
    assert sorted((r.doc_id or 0, r.said) for r in found) == [(0, "assign:0:14"), (0, "assign:0:14"), (1, ""), (2, "assign:500001:500017")]
