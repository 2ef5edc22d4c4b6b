import itertools

import numpy as np

from daftar.llm import segments
from daftar.llm.pieces import load
from daftar.llm.queries import piece_model


def by_enumeration(word, pieces, p):
    """Sum over all ways to cut a word, letters outside pieces included."""
    text, total = segments.START + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                parts.append(text[at:i])
                at = i
        product = 1.0
        for part in parts:
            product *= (p[pieces.index(part)] if part in pieces else 0) + (segments.FLOOR if len(part) == 1 else 0)
        total += product
    return total


def test_forward_sums_all_segmentations():
    pieces = ("▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab", "bb")
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    model = segments.Model(pieces, ("x", "y"), p)
    words = ["a", "ab", "abab", "bbab", "zab", "abz"]
    got = model.word_scores(words, segments.Lattice(pieces)) - np.log(segments.PER_LETTER) * (np.array([len(w) + 1 for w in words])[:, None])
    want = [[np.log(by_enumeration(w, pieces, p[:, k])) for k in range(2)] for w in words]
    assert np.allclose(got, want)


def test_fitting_raises_the_likelihood():
    pieces = ("▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc")
    words, counts = ["abc", "ab", "cab", "bca"], np.array([[5.0, 0], [3, 1], [0, 4], [1, 6]])
    lattice, last = segments.Lattice(pieces), -np.inf
    for rounds in (1, 2, 4, 8):
        model = segments.fit(words, counts, pieces, ("x", "y"), rounds)
        now = (model.word_scores(words, lattice) * counts).sum()
        assert now >= last - 0.2
        last = now


def test_held_out_accuracy_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pieces = list(load(piece_model()).pieces)
    model = segments.learn(df, pieces)
    rows = segments.identify(df, pieces, model).join(df.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    right = np.mean([r.lang_pred == r.lang for r in rows if r.lang_pred != "und"])
    assert len(rows) > 1500 and right > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "12 ,.", "x"), (None, "the and of that", None), (4, "the and of that", "x"), (4, "the and of that", "x"), (5, "the and of that " * 80_000, "x"), (6, "e" * 3_000_000, "x")],
        "doc_id long, text string, score string",
    )
    got = sorted((r.doc_id or 0, r.lang_pred) for r in segments.identify(odd, pieces, model).collect())
    assert got[:6] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")] and got[6] == (5, "en")
    empty = df.limit(0)
    assert segments.identify(empty, pieces).collect() == []
    assert [r.lang_pred for r in segments.identify(odd.withColumn("lang", odd.score.substr(2, 0)).filter("doc_id = 4").selectExpr("doc_id", "text", "cast(null as string) as lang"), pieces).collect()] == ["und", "und"]


def test_every_language_is_learned_whatever_its_texts_are_like(spark):
    """Long texts only, one text many times over, words longer than the lattice; each is predicted again."""
    pieces = list(load(piece_model()).pieces)
    english, german = "the and of that with from this which ", "der und die nicht auch eine wird sich "
    french, glued = "les des dans pour avec cette sont plus ", "donaudampfschifffahrtsgesellschaft" * 5 + " "
    rows = [(i, english * 3, "en") for i in range(40)] + [(100 + i, german * 4000, "de") for i in range(20)]
    rows += [(200 + i, french * 5, "fr") for i in range(3000)] + [(4000 + i, glued * (i + 2), "xx") for i in range(20)]
    rows += [(5000 + i, None, "null") for i in range(9)] + [(6000 + i, "12 .", "digits") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for shift in (0, 100_000):
        model = segments.learn(df.withColumn("doc_id", df.doc_id + shift), pieces)
        assert model.languages == ("de", "en", "fr", "xx")
        asked = spark.createDataFrame([(1, english, "-"), (2, german * 9000, "-"), (3, french, "-"), (4, glued, "-")], df.schema)
        assert [r.lang_pred for r in segments.identify(asked, pieces, model).orderBy("doc_id").collect()] == ["en", "de", "fr", "xx"]
