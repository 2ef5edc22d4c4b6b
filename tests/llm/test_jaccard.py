import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from daftar.llm import jaccard
from daftar.llm.components import components
from daftar.llm.jaccard import Keys, keys_of, most_different, near_duplicates
from daftar.llm.shingles import shingle_set, word_hashes

SCHEMA = "doc_id long, text string"


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def families(seed: int, n: int) -> dict:
    """Documents of one to 200 words, many of them edited copies of others."""
    rng, docs = random.Random(seed), {}
    word = lambda: f"w{rng.randrange(40 if rng.random() < 0.5 else 4000)}"
    passage = [f"p{i}" for i in range(30)]
    for i in range(n):
        if docs and rng.random() < 0.7:
            words = (docs[rng.choice(list(docs))] or "x").split() or ["x"]
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
                words = words or ["x"]
        else:
            words = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9, 12, 20, 50, 200]))]
            if rng.random() < 0.3:
                words = passage + words
        docs[i * 3] = " ".join(words)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = families(seed, 400)
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(5)
    assert answer(near_duplicates(df)) == brute.near_duplicates(docs)


def test_long_sets_against_all_pairs(spark):
    """Sets beyond the bands of single elements, with passages shared by unlike documents."""
    rng, docs = random.Random(4), {}
    passage = [f"p{i}" for i in range(300)]
    for i in range(160):
        if docs and rng.random() < 0.6:
            words = rng.choice(list(docs.values())).split()
            for _ in range(rng.randrange(25)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([330, 500, 900, 1500]))]
            words[100:100] = passage if rng.random() < 0.5 else []
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(5)
    assert answer(near_duplicates(df)) == brute.near_duplicates(docs)


def test_given_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = dict(zip(*pq.read_table(path, columns=["doc_id", "text"]).to_pydict().values()))
    df = spark.read.parquet(path)
    assert answer(near_duplicates(df)) == brute.near_duplicates(docs)


def test_keys_meet_for_every_linked_pair():
    """Any two sets that link share a key that one probes and the other indexes, crowded sets included."""
    rng = np.random.default_rng(3)
    everything = set(range(60))
    for _ in range(3000):
        n = int(rng.integers(1, 40 if rng.random() < 0.5 else 1500))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        if rng.random() < 0.3:  # crowd the elements into few segments
            x = np.unique(x >> np.uint64(rng.integers(1, 30)))
        differ = len(x) // 3
        drop = int(rng.integers(0, differ + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, differ - drop, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        (kx, ux), (ky, uy) = (keys_of(s, everything, everything) for s in (x, y))
        uses = [{}, {}]
        for of, ks, us in ((uses[0], kx, ux), (uses[1], ky, uy)):
            for k, u in zip(ks.tolist(), us.tolist(), strict=True):
                of.setdefault(k, set()).add(u)
        # one indexes (0, 2) what the other may or has to probe (0, 1, 3)
        meets = lambda p, q: bool(p & {0, 2} and q & {0, 1, 3})
        assert any(meets(u, uses[1].get(k, set())) or meets(uses[1].get(k, set()), u) for k, u in uses[0].items())


def test_crowded_sets_need_deletions_and_blanks():
    crowded = np.arange(1, 401, dtype=np.uint64)
    keys = Keys(crowded, int(np.searchsorted(jaccard._LOWS, 400, "right")) - 1)
    assert len(keys.full) == 1 and keys.missing == keys.differ and len(keys.loose) == 1 and keys.blank == keys.missing - 1


def test_edge_cases(spark):
    long_text = " ".join(f"word{i}" for i in range(300_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two", None), (5, "ONE  two\n", "b"), (None, "one two", "c"),
            (6, long_text, "d"), (7, long_text + " end", "d"), (8, "one two three", "e"), (9, "é É x y z", "e"), (10, "É É x y z", "e"),
            (8, "one two three", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string").withColumnRenamed("a", "component_id")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 299_996, 6), (7, 299_997, 6),
                   (8, 1, 8), (8, 1, 8), (9, 1, 9), (10, 1, 10)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c"), (5, "d e f"), (1, "a b c"), (7, "d e f")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 1), (1, 1), (7, 1)}


def test_words_are_hashed_alike_in_slices(monkeypatch):
    text = "Ab c\tde  fgh\x0bijk " * 500 + "z" * 3000 + " end"
    whole = word_hashes(text)
    monkeypatch.setattr("daftar.llm.shingles.SLICE", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == 500 * 5 + 2
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A b C")) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 205), (205, 203), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for a, b in edges for x in (a, b) if a != b}, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_parts_do_not_change_the_result(spark, monkeypatch):
    docs = families(9, 150)
    monkeypatch.setattr(jaccard, "KEYS_PER_PART", 500)
    assert answer(near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA))) == brute.near_duplicates(docs)


def test_near_copies_in_several_components(spark, monkeypatch):
    """2,000 copies of one text, each edited by itself, some too much for most others; blocks of few documents."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    docs = {}
    for i in range(2000):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(300)}"
        docs[i] = " ".join(words)
    want = brute.near_duplicates(docs)
    assert len({c for _, c in want.values()}) > 20
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(6)
    assert answer(near_duplicates(df)) == want
    monkeypatch.setattr(jaccard, "ELEMENTS", 9_000)
    monkeypatch.setattr(jaccard, "PAIRS_PER_BLOCK", 50)
    assert answer(near_duplicates(df)) == want
