"""Toxicity by a recurrent network over all overlapping windows of a text.

A word enters as its own vector, if it is common enough to have one, joined with the mean
of vectors of its letter triples. Gated recurrent units read a window of words in both
directions, attention pools their states, and a document scores as its worst window. The
network is trained in numpy on a bounded sample of labelled documents: labels belong to
documents, so each round trains on the windows that the network finds worst so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.boosting import platt
from daftar.llm.segments import held_out
from daftar.llm.shared import small_batches

PER_CLASS = 1000  # labelled documents of each class the network learns from
PIECE_CHARS, PIECES = 20_000, 20  # of a document that has more pieces of this length, so many are used for learning
WINDOW, STEP = 32, 16  # words
WORD_DIM, TRIPLE_DIM, HIDDEN = 12, 8, 8
VOCABULARY, LEAST_DOCS = 20_000, 4
TRIPLES = 1 << 13
LETTERS = 24  # of a word; longer runs of letters, as without spaces between words, are several words
ROUNDS, BATCH, RATE = 10, 64, 0.01
REMEMBERED = 200_000  # words kept per worker
AT_ONCE = 2048  # windows scored together
WORDS = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")
LETTER, LETTERS_ON = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]*")


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter triples of words with marks for both ends, and how many each word has."""
    marked = [f"\x02{w}\x03" for w in words]
    sizes = np.array([len(w) for w in marked])
    codes = np.zeros((len(words), LETTERS + 2), dtype=np.int64)
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes[np.arange(LETTERS + 2) < sizes[:, None]] = flat
    hashed = (codes[:, :-2] * 0x9E3779B1 + codes[:, 1:-1] * 0x85EBCA77 + codes[:, 2:] * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
    return (hashed >> 13) % TRIPLES, sizes - 2


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name; gates stand in the order update, reset, candidate."""

    vocabulary: dict[str, int]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        w = {"words": normal(len(vocabulary) + 1, WORD_DIM), "triples": normal(TRIPLES, TRIPLE_DIM)}
        for side in "fb":
            w |= {f"x{side}": normal(WORD_DIM + TRIPLE_DIM, 3 * HIDDEN), f"h{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"att": normal(2 * HIDDEN, HIDDEN), "att_v": normal(HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        return cls(vocabulary, w)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the rows they come from: word row, triples and their numbers."""
        row = np.array([self.vocabulary.get(w, 0) for w in words])
        grams, sizes = triples(words)
        inside = (np.arange(grams.shape[1]) < sizes[:, None])[..., None]
        mean = (self.w["triples"][grams] * inside).sum(axis=1) / np.maximum(sizes, 1)[:, None]
        return np.concatenate([self.w["words"][row], mean], axis=1).astype(np.float32), row, grams, sizes

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb"], axis=1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from projected inputs (windows x words x 6 hidden); the steps too if kept for training."""
        n, length, states, steps = len(gates), gates.shape[1], [], {}
        for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h, u = np.zeros((n, HIDDEN), np.float32), self.w[f"h{side}"]
            part = slice(0, 3 * HIDDEN) if side == "f" else slice(3 * HIDDEN, 6 * HIDDEN)
            out = np.zeros((n, length, HIDDEN), np.float32)
            for t in order:
                hu, g = h @ u, gates[:, t, part]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * hn)
                after = h + mask[:, t, None] * (1 - z) * (c - h)
                if keep:
                    steps[side, t] = h, z, r, hn, c
                h = after
                out[:, t] = h
            states.append(out)
        both = np.concatenate(states, axis=2)
        a = np.tanh(both @ self.w["att"])
        e = np.where(mask > 0, a @ self.w["att_v"], -1e9)
        share = np.exp(e - e.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share[..., None] * both).sum(axis=1)
        logit = pooled @ self.w["out"] + self.w["bias"][0]
        return (logit, (steps, both, a, share, pooled)) if keep else logit

    def gradients(self, gates: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean logistic loss: by parameter behind the inputs, and by projected input."""
        logit, (steps, both, a, share, pooled) = self.run(gates, mask, keep=True)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        out = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.w["out"]
        d_both = share[..., None] * d_pooled[:, None]
        d_share = (both * d_pooled[:, None]).sum(axis=2)
        d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        out["att_v"] = (a * d_e[..., None]).sum(axis=(0, 1))
        d_a = d_e[..., None] * self.w["att_v"] * (1 - a * a)
        out["att"] = np.einsum("nti,ntj->ij", both, d_a)
        d_both += d_a @ self.w["att"].T
        d_gates = np.zeros_like(gates)
        length = gates.shape[1]
        for i, (side, order) in enumerate((("f", range(length - 1, -1, -1)), ("b", range(length)))):
            u, d_u = self.w[f"h{side}"], np.zeros_like(self.w[f"h{side}"])
            d_h = np.zeros((len(gates), HIDDEN), np.float32)
            for t in order:
                h, z, r, hn, c = steps[side, t]
                d_h = d_h + d_both[:, t, i * HIDDEN : (i + 1) * HIDDEN]
                m = mask[:, t, None]
                d_c = d_h * m * (1 - z) * (1 - c * c)
                d_z = d_h * m * (h - c) * z * (1 - z)
                d_r = d_c * hn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_c], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_hu
                d_gates[:, t, 3 * HIDDEN * i : 3 * HIDDEN * (i + 1)] = d_g
                d_h = d_h * (1 - m * (1 - z)) + d_hu @ u.T
            out[f"h{side}"] = d_u
        return out, d_gates


class _Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.m, self.v, self.t = w, {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-6)).astype(np.float32)


def _slots(index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows and which places are filled."""
    at = starts[:, None] + np.arange(WINDOW)
    filled = at < len(index)
    return index[np.minimum(at, max(0, len(index) - 1))] if len(index) else np.zeros(at.shape, np.int64), filled.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> tuple[Network, float, float]:
    """A network, and slope and offset that turn a document's worst logit into a probability."""
    rng = np.random.default_rng(3)
    split = [WORDS.findall(t.lower()) for t in texts]
    seen: dict[str, int] = {}
    for words in split:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w, n in seen.items() if n >= LEAST_DOCS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network.fresh({w: i + 1 for i, w in enumerate(common)})
    names = sorted(seen)
    place = {w: i for i, w in enumerate(names)}
    index = [np.array([place[w] for w in words], dtype=np.int32) for words in split]
    del split, place
    starts = [windows(len(i)) for i in index]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    slots, masks = (np.concatenate(c) for c in zip(*[_slots(i, s) for i, s in zip(index, starts, strict=True)], strict=True))
    first = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
    full = masks[:, 0] > 0
    adam = _Adam(net.w)

    def logits() -> np.ndarray:
        table = np.concatenate([net.projected(net.inputs(names[i : i + 20_000])[0]) for i in range(0, len(names), 20_000)])
        return np.concatenate([net.run(table[slots[i : i + AT_ONCE]], masks[i : i + AT_ONCE]) for i in range(0, len(slots), AT_ONCE)])

    def worst(scores: np.ndarray) -> np.ndarray:
        order = np.lexsort((-scores, owner))
        return order[first[:-1]]

    for turn in range(rounds):
        random = first[:-1] + (rng.random(len(texts)) * np.diff(first)).astype(np.int64)
        chosen = random
        if turn:
            at = worst(logits())
            chosen = np.concatenate([at, random[labels == 0]])  # toxic documents need not be toxic throughout
        chosen = chosen[full[chosen]]
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
            if not len(part):
                continue
            used, inverse = np.unique(slots[part], return_inverse=True)
            x, row, grams, sizes = net.inputs([names[i] for i in used])
            hidden = rng.random(len(used)) < 0.1  # words now and then go by their letters alone
            x[hidden, :WORD_DIM] = net.w["words"][0]
            row[hidden] = 0
            gates = net.projected(x)[inverse.reshape(len(part), WINDOW)]
            g, d_gates = net.gradients(gates, masks[part], labels[owner[part]].astype(np.float32))
            d_table = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(d_table, inverse.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
            d_x = np.zeros_like(x)
            for i, side in enumerate("fb"):
                d = d_table[:, 3 * HIDDEN * i : 3 * HIDDEN * (i + 1)]
                g[f"x{side}"], g[f"c{side}"] = x.T @ d, d.sum(axis=0)
                d_x += d @ net.w[f"x{side}"].T
            g["words"], g["triples"] = np.zeros_like(net.w["words"]), np.zeros_like(net.w["triples"])
            np.add.at(g["words"], row, d_x[:, :WORD_DIM])
            inside = np.arange(grams.shape[1]) < sizes[:, None]
            spread = np.repeat(d_x[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0)
            np.add.at(g["triples"], grams[inside], spread)
            adam.step(g)
    scores = logits()
    slope, offset = platt(scores[worst(scores)].astype(float), labels.astype(float))
    return net, slope, offset


@dataclass
class Model:
    network: Network
    slope: float
    offset: float
    blank: float  # the score of a text without words


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on labelled documents outside the held-out fold; None unless both labels occur."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out() & F.col("text").isNotNull())
    marks = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels first: only the sample's documents are then looked up
    drawn = [
        marks.filter(~held_out() & (F.col("toxic") == k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for k in (0, 1)
    ]
    # of rows that share an identifier the least text, and of a very long one some pieces: what is drawn
    # is bounded. A toxic document is toxic somewhere, so shorter ones are learned from whole
    texts = known.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    mixed = F.array_sort(F.transform(pieces, lambda p, i: F.struct(F.xxhash64("doc_id", i).alias("at"), p.alias("piece"))))
    some = F.array_join(F.transform(F.slice(mixed, 1, PIECES), lambda p: p["piece"]), " ")
    text = F.when(F.length("text") > PIECES * PIECE_CHARS, some).otherwise(F.col("text"))
    table = texts.select("doc_id", text.alias("text"), "toxic").toArrow().sort_by([("doc_id", "ascending")])
    y = table.column("toxic").to_numpy().astype(int)
    if not 0 < y.sum() < len(y):
        return None
    net, slope, offset = train(table.column("text").to_pylist(), y)
    return Model(net, slope, offset, 0.0)


class Scorer:
    """Scores of texts, with words' projected inputs kept between batches."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def know(self, words: set[str]) -> None:
        if len(self.place) + len(words) > REMEMBERED:
            self.place, self.table = {}, self.table[:0]
        new = sorted(words - self.place.keys())
        net = self.model.network
        blocks = [self.table, *[net.projected(net.inputs(new[i : i + 20_000])[0]) for i in range(0, len(new), 20_000)]]
        self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate(blocks)

    def _slices(self, text: str, size: int = 1 << 18) -> Iterator[list[str]]:
        """The words of a text, in slices that end between words."""
        at = 0
        while at < len(text):
            end = min(at + size, len(text))
            start = end
            while start > at and LETTER.match(text[start - 1]):
                start -= 1
            end = LETTERS_ON.match(text, end, min(len(text), at + 2 * size)).end()
            if end < len(text) and LETTER.match(text[end]):  # an endless run of letters is cut between its words
                end = start + (end - start) // LETTERS * LETTERS
            yield WORDS.findall(text[at:end].lower())
            at = end

    def _blocks(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The windows of a whole text, in blocks; words of unfinished windows are carried over between slices."""
        rest: list[str] = []
        slices = self._slices(text)
        words = next(slices, None)
        while words is not None:
            following = next(slices, None)
            rest = rest + words
            distinct = set(rest)
            if not distinct <= self.place.keys():
                self.know(distinct)
            index = np.fromiter(map(self.place.__getitem__, rest), dtype=np.int64, count=len(rest))
            # the window that ends with the text belongs to the last slice alone
            kept = max(0, (len(index) - WINDOW) // STEP * STEP)
            starts = windows(len(index)) if following is None else np.arange(0, kept, STEP)
            if len(index) and len(starts):
                slots, mask = _slots(index, starts)
                yield self.table[slots], mask
            rest, words = rest[kept:], following

    def worst(self, text: str) -> float | None:
        best = None
        for gates, mask in self._blocks(text):
            for i in range(0, len(gates), AT_ONCE):
                top = float(self.model.network.run(gates[i : i + AT_ONCE], mask[i : i + AT_ONCE]).max())
                best = top if best is None else max(best, top)
        return best

    def scores(self, texts: list[str | None]) -> list[float]:
        """Short texts' windows are run together, long texts one by one."""
        out: list[float | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if t and len(t) <= 1 << 16]
        for i in set(range(len(texts))) - set(short):
            out[i] = self.worst(texts[i]) if texts[i] else None
        split = {i: WORDS.findall(texts[i].lower()) for i in short}
        self.know({w for words in split.values() for w in words})
        group: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if group:
                slots, masks = np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group])
                logit = np.concatenate([self.model.network.run(self.table[slots[a : a + AT_ONCE]], masks[a : a + AT_ONCE]) for a in range(0, len(slots), AT_ONCE)])
                at = 0
                for i, s, _ in group:
                    out[i] = float(logit[at : at + len(s)].max())
                    at += len(s)
                group.clear()

        for i, words in split.items():
            if words:
                index = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
                group.append((i, *_slots(index, windows(len(index)))))
                if sum(len(g[1]) for g in group) > 4 * AT_ONCE:
                    flush()
        flush()
        m = self.model
        return [m.blank if x is None else float(_sigmoid(np.clip(m.slope * x + m.offset, -30, 30))) for x in out]


def _with_scores(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``docs`` with the score of ``text`` in a further column."""
    small_batches(docs.sparkSession)
    names, at = [*docs.columns, name], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            scores = scorer.scores(batch.column(at).to_pylist()) if scorer else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs`` (doc_id, text).

    Null texts and texts without a letter score 0, and so does everything if the labels show
    one class only. Labels of a document that contradict each other count as toxic; null
    labels are ignored. Rows are scored one by one, repeated rows and null ids included; an
    empty table gives an empty table. Other columns are ignored.
    """
    model = model or learn(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = _with_scores(rows, model, "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below 0.5, with their columns as they are."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    scored = _with_scores(docs.withColumn("text", F.col("text").cast("string")), learn(docs, labels), name)
    return scored.filter(F.col(name) < 0.5).drop(name)
