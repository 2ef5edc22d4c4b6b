import numpy as np
import pytest

from daftar.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh({})
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    gates = rng.normal(size=(3, 6, 6 * toxicity.HIDDEN))
    mask = (np.arange(6) < np.array([6, 4, 1])[:, None]).astype(float)
    y = np.array([1.0, 0, 1])

    def loss():
        z = net.run(gates, mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g, d_gates = net.gradients(gates, mask, y)
    for name, grad in [*g.items(), ("gates", d_gates)]:
        array = gates if name == "gates" else net.w[name]
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-4, name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 47, 48, 49, 100, 1000])
def test_windows_cover_every_word_and_overlap(n):
    starts = toxicity.windows(n)
    covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
    assert covered == set(range(n)) and (np.diff(starts) <= toxicity.STEP).all() and starts[-1] + toxicity.WINDOW >= n


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.learn(*tables)


def test_held_out_quality(tables, model):
    docs, labels = tables
    rows = toxicity.score(docs, labels, model).join(labels, "doc_id").filter("held_out").collect()
    p, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = np.argsort(np.argsort(p))
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    assert len(rows) > 600 and auc > 0.95 and ((p >= 0.5) == y).mean() > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_long_texts_are_scored_whole(model):
    scorer = toxicity.Scorer(model)
    words = "of the on thtion it and erth was in hain".split()
    clean = " ".join(words * 12_000)
    bad = clean + " idiot moron stupid trash pathetic worthless clown scum loser disgusting"
    a, b = scorer.scores([clean, bad])
    assert b > 0.5 > a
    short = " ".join(words * 300)
    assert abs(scorer.worst(short) - max(scorer.worst(short[:700]), scorer.worst(short))) < 1e-4


def plain_score(model, text):
    """One window after the other, every word by itself."""
    words = toxicity.WORDS.findall((text or "").lower())
    if not words:
        return model.blank
    net, best = model.network, -np.inf
    for start in toxicity.windows(len(words)):
        part = words[start : start + toxicity.WINDOW]
        gates = np.zeros((1, toxicity.WINDOW, 6 * toxicity.HIDDEN), np.float32)
        for i, word in enumerate(part):
            gates[0, i] = net.projected(net.inputs([word])[0])[0]
        mask = (np.arange(toxicity.WINDOW) < len(part))[None, :]
        best = max(best, float(net.run(gates, mask.astype(np.float32))[0]))
    return 1 / (1 + np.exp(-np.clip(model.slope * best + model.offset, -30, 30)))


def test_scores_are_those_of_a_plain_loop_over_windows(model, monkeypatch):
    rng = np.random.default_rng(1)
    some = "of the on thtion it and erth was in hain idiot moron trash über café ﬁx".split()
    texts = [None, "", "12", *[" ".join(rng.choice(some, n)) for n in (1, 5, 31, 32, 33, 47, 48, 49, 64, 65, 200, 1000)], "x" * 700 + " idiot", "é" * 5000]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-4)
    # the same through slices of any size, as for long texts
    parts = toxicity.Scorer._slices
    for size in (40, 300, 5000):
        monkeypatch.setattr(toxicity.Scorer, "_slices", lambda self, t, size=size: parts(self, t, size))
        scorer = toxicity.Scorer(model)
        for text, score in zip(texts[3:], want[3:]):
            assert "".join(w for words in scorer._slices(text) for w in words) == "".join(toxicity.WORDS.findall(text.lower()))
            assert abs(1 / (1 + np.exp(-np.clip(model.slope * scorer.worst(text) + model.offset, -30, 30))) - score) < 1e-4


def test_slices_give_the_windows_of_the_whole(model, monkeypatch):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(50_057)) + " idiot moron trash"
    n = len(toxicity.WORDS.findall(text))
    parts = toxicity.Scorer._slices
    for size in (500, 1 << 18):
        monkeypatch.setattr(toxicity.Scorer, "_slices", lambda self, t, size=size: parts(self, t, size))
        assert sum(len(gates) for gates, _ in toxicity.Scorer(model)._blocks(text)) == len(toxicity.windows(n))


def test_long_documents_are_learned_from(spark):
    """Labelled documents that are all long, and one identifier with many rows."""
    rows = [(i, ("of the thtion and erth " * 6000) + ("idiot moron trash " * 2000 if i % 2 else "was in hain ")) for i in range(60)]
    rows += [(1, "of the") for _ in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels) is not None


def test_edge_cases(spark, tables, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 .", "a"), (None, "the of", None), (4, "x" * 100_000, "b"), (4, "x" * 100_000, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(df, tables[1], model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.score(df.limit(0), tables[1], model).collect() == []
    assert {r.score for r in toxicity.score(df, tables[1].filter("toxic = 0")).collect()} == {0.0}


def test_every_letter_of_a_long_run_is_read():
    run = "".join(map(chr, range(0x4E00, 0x4E00 + 100)))
    words = toxicity.WORDS.findall(f"a {run} b")
    assert "".join(words[1:-1]) == run and max(map(len, words)) == toxicity.LETTERS
    other = toxicity.WORDS.findall(f"a {run[:50]}x{run[51:]} b")
    assert (toxicity.triples(words)[0] != toxicity.triples(other)[0]).any()
