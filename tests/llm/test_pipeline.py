"""The stages over a small table, each against what a plain version makes of its own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from daftar.llm import mixing, pii
from daftar.llm.shared import stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF), f"test-{name}")
        out.append((before.collect(), docs.collect()))
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_keep_the_columns(steps):
    for _, after in steps[:-1]:
        assert list(after[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_drops_what_scores_as_toxic(spark, steps):
    before, after = steps[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(before)) - set(ids(after))
    toxic = {d for d, t in labels.items() if t == 1}
    assert len(gone & toxic) >= 0.9 * len(toxic) and sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(labels)


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    found = brute.near_duplicates({r.doc_id: r.text for r in before})
    assert ids(after) == sorted(d for d, (_, c) in found.items() if d == c)


def test_base_findings_are_gone(steps):
    before, after = steps[2]
    assert ids(before) == ids(after)
    texts = {r.doc_id: r.text for r in after}
    changed = [r for r in before if pii.base_spans(r.text)]
    assert changed and all("@mail" not in texts[r.doc_id] for r in changed)
    quiet = [r for r in before if not pii.base_spans(r.text)]
    assert sum(texts[r.doc_id] != r.text for r in quiet) <= 0.02 * len(quiet)


def test_mix_follows_its_plan(spark, steps):
    before, after = steps[3]
    plan = {r.doc.doc_id: len(r.positions) for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert ids(after) == sorted(d for d, n in plan.items() for _ in range(n))
    assert len(steps[4][1]) == len(after) and set(steps[4][1][0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_gives_what_its_stages_give(spark, steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
    rows = lambda some: sorted(tuple(r) for r in some)
    assert rows(corpus_pipeline.run(spark, SF).collect()) == rows(steps[-1][1])


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those that stages make."""
    long_text = " ".join(f"word{i % 97} thed" for i in range(40_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "the of and", "en", "a", 10), (3, "the of and", "en", "a", 10),
            (4, "The OF and", "en", None, 10), (None, "mail me@x.org now or later today", None, "b", 1), (5, long_text, "en", "b", 1), (6, long_text + " end", "en", "b", 1),
            (7, "call +1 (617) 555-0100 now", "en", "a", 1), (8, "12 .", None, "c", 4)]
    names = ["toxicity", "score", "component_id", "rep", "spans", "size", "positions", "h", "bucket", "n_tokens", "held_out", "v"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]), names


def test_stages_on_odd_rows(spark):
    docs, names = odd(spark)
    step = dict(corpus_pipeline.STAGES)
    columns, empty = docs.columns, docs.limit(0)
    kept = step["toxicity"](spark, docs, SF)
    assert kept.columns == columns and kept.count() == docs.count()
    one = step["jaccard"](spark, docs, SF)
    texts = [(r.doc_id, r.text and r.text[:20]) for r in one.collect()]
    # the copies of 3 and of the long text go; rows without words or id stay
    assert one.columns == columns and sorted(d for d, _ in texts if d is not None) == [1, 2, 3, 5, 7, 8] and sum(d is None for d, _ in texts) == 2
    clean = step["pii"](spark, docs, SF)
    assert clean.columns == columns and clean.count() == docs.count()
    assert {r.text for r in clean.filter("doc_id is null or doc_id in (1, 7)").collect()} == {None, "mail [EMAIL] now or later today", "call [PHONE] now"}
    mixed = step["mixing"](spark, docs, SF)
    assert mixed.columns == columns and all(r[n] == i for r in mixed.collect() for i, n in enumerate(names))
    encoded = step["sentencepiece"](spark, docs, SF)
    assert encoded.count() == docs.count() and encoded.filter("doc_id = 1").first().n_tokens == 2
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SF).collect() == [], name
