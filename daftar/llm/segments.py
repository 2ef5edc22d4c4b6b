"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, found by a forward pass over
its letters; a text's is the product over its words. The piece probabilities are fitted by
expectation and maximisation on words of a bounded sample, with the same lattice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.llm.shared import small_batches

PIECES_PER_LANGUAGE = 400  # distinct pieces of text drawn for fitting
PIECE_CHARS = 20_000  # longer texts are cut into pieces of this length
ROUNDS = 4
LONGEST = 48  # letters; longer words are scored in stretches
FLOOR = 1e-7  # probability of a letter outside all pieces, the same in every language
PER_LETTER = 20.0  # keeps forward sums in range; cancels out between languages
REMEMBERED = 400_000  # words kept per worker
START = "▁"
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


class Lattice:
    """All pieces inside words, by a trie held as sorted transitions."""

    def __init__(self, pieces: tuple[str, ...]):
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.base = len(self.letters) + 1
        nodes, ends = {"": 0}, {}
        for i, piece in enumerate(pieces):
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
            ends[nodes[piece]] = i
        keys = sorted((nodes[p[:-1]] * self.base + self.letters[p[-1]], node) for p, node in nodes.items() if p)
        self.keys, self.to = (np.array(c, dtype=np.int64) for c in zip(*keys, strict=True)) if keys else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        for node, i in ends.items():
            self.piece[node] = i
        self.deepest = max(map(len, pieces), default=0)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) + 1 for w in words])
        out = np.zeros((len(words), int(sizes.max(initial=1))), dtype=np.int64)
        for i, word in enumerate(words):
            out[i, : sizes[i]] = [self.letters.get(c, 0) for c in START + word]
        return out, sizes

    def arcs(self, codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """By start and length: rows of words that hold a piece there, and the pieces."""
        for start in range(codes.shape[1]):
            rows, node = np.flatnonzero(sizes > start), np.zeros(1, dtype=np.int64)
            node = np.zeros(len(rows), dtype=np.int64)
            for n in range(1, self.deepest + 1):
                inside = sizes[rows] >= start + n
                rows, node = rows[inside], node[inside]
                if not len(rows):
                    break
                key = node * self.base + codes[rows, start + n - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                rows, node = rows[known], self.to[at[known]]
                whole = self.piece[node] >= 0
                if whole.any():
                    yield start, n, rows[whole], self.piece[node[whole]]


def forward(codes: np.ndarray, sizes: np.ndarray, arcs, p: np.ndarray) -> np.ndarray:
    """Scaled sums over all segmentations of every prefix: words x positions x languages."""
    alpha = np.zeros((len(codes), codes.shape[1] + 1, p.shape[1]))
    alpha[:, 0] = 1
    done = -1
    for start, n, rows, piece in arcs:
        while done < start:  # the letter on its own, known to every language
            done += 1
            alpha[:, done + 1] += alpha[:, done] * (FLOOR * PER_LETTER)
        alpha[rows, start + n] += alpha[rows, start] * p[piece] * PER_LETTER**n
    while done < codes.shape[1] - 1:
        done += 1
        alpha[:, done + 1] += alpha[:, done] * (FLOOR * PER_LETTER)
    return alpha


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    languages: tuple[str, ...]
    p: np.ndarray  # pieces x languages

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        codes, sizes = lattice.codes(words)
        alpha = forward(codes, sizes, lattice.arcs(codes, sizes), self.p)
        return np.log(np.maximum(alpha[np.arange(len(words)), sizes], 1e-300))


def fit(words: list[str], counts: np.ndarray, pieces: tuple[str, ...], languages: tuple[str, ...], rounds: int = ROUNDS) -> Model:
    """Expectation and maximisation of piece probabilities; ``counts`` is words x languages."""
    lattice = Lattice(pieces)
    p = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        expected = np.full_like(p, 0.02)
        for at in range(0, len(words), 20_000):
            part, weight = words[at : at + 20_000], counts[at : at + 20_000]
            codes, sizes = lattice.codes(part)
            arcs = list(lattice.arcs(codes, sizes))
            alpha = forward(codes, sizes, arcs, p)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(part)), sizes] = 1
            place, at_arc = codes.shape[1], len(arcs) - 1
            while place > 0:
                place -= 1
                beta[:, place] += beta[:, place + 1] * (FLOOR * PER_LETTER)
                while at_arc >= 0 and arcs[at_arc][0] == place:
                    start, n, rows, piece = arcs[at_arc]
                    beta[rows, start] += beta[rows, start + n] * p[piece] * PER_LETTER**n
                    at_arc -= 1
            share = weight / np.maximum(beta[:, 0], 1e-300)
            for start, n, rows, piece in arcs:
                flow = alpha[rows, start] * p[piece] * PER_LETTER**n * beta[rows, start + n] * share[rows]
                for k in range(p.shape[1]):
                    expected[:, k] += np.bincount(piece, flow[:, k], len(p))
        p = expected / expected.sum(axis=0)
    return Model(pieces, languages, p)


def held_out() -> Column:
    """crc32 of the identifier as text leaves no remainder by 5; a null identifier is taken as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def usable_pieces(pieces: list[str]) -> tuple[str, ...]:
    """Pieces that can stand in a lower-case word: letters only, a mark for the word's start at most in front."""
    return tuple(p for p in pieces if p.removeprefix(START).isalpha() and p == p.lower() or p == START)


def learn(docs: DataFrame, pieces: list[str]) -> Model | None:
    """Fit on documents outside the held-out fold that have a language; None if there are none.

    Every language of such documents with a letter is learned, from up to ``PIECES_PER_LANGUAGE``
    distinct pieces of its texts of any length.
    """
    lang = F.col("lang").cast("string").alias("lang")
    parts = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    known = docs.filter(~held_out() & F.col("lang").isNotNull()).select(lang, F.explode(parts).alias("piece"))
    known = known.filter(F.col("piece").rlike(r"\p{L}")).withColumn("h", F.xxhash64("piece"))
    # distinct pieces by their hashes: copies neither fill nor thin the sample, and long texts take part
    first = W.partitionBy("lang").orderBy("h")
    drawn = known.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PIECES_PER_LANGUAGE)
    texts = known.join(drawn.select("lang", "h"), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("piece"), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), F.lit(0))).alias("word"))
    table = words.groupBy("word", "lang").count().orderBy("word", "lang").toArrow()
    names = tuple(sorted(set(table.column("lang").to_pylist())))
    if not names:
        return None
    distinct = sorted(set(table.column("word").to_pylist()))
    place, column = {w: i for i, w in enumerate(distinct)}, {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(distinct), len(names)))
    for word, lang, n in zip(*(table.column(c).to_pylist() for c in ("word", "lang", "count")), strict=True):
        counts[place[word], column[lang]] = n
    return fit(distinct, counts, usable_pieces(pieces), names)


class Scorer:
    """Scores of texts, with the words' scores kept between batches."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _learn_words(self, words: set[str]) -> None:
        if len(self.place) + len(words) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
        new = sorted(words - self.place.keys())
        blocks = [self.scores] + [self.model.word_scores(new[i : i + 20_000], self.lattice) for i in range(0, len(new), 20_000)]
        self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate(blocks)

    def totals(self, text: str, size: int = 1 << 20) -> np.ndarray | None:
        """Sums of the words' log probabilities; None without a letter. Works through long texts a slice at a time."""
        total, some, at = np.zeros(len(self.model.languages)), False, 0
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and end < at + 2 * size and text[end].isalpha():
                end += 1
            words = WORDS.findall(text[at:end].lower())
            some = some or any(any(map(str.isalpha, w)) for w in words)
            long = [w for w in words if len(w) > LONGEST]
            if long:
                words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
            distinct = set(words)
            if not distinct <= self.place.keys():
                self._learn_words(distinct)
            index = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            total += self.scores[index].sum(axis=0)
            at = end
        return total if some else None


def identify(docs: DataFrame, pieces: list[str], model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row of ``docs`` (doc_id, text, lang).

    ``und`` with score 0 stands for null texts, texts without a letter, and for everything
    if no row has a language to learn from. Ties go to the language that sorts first. Rows
    are judged one by one, repeated ones and null ids included; an empty table gives an empty
    table. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or learn(docs, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            names, scores = [], []
            texts = batch.column(2).to_pylist()
            if scorer:  # words of the whole batch are scored together
                scorer._learn_words({w[i : i + LONGEST] for t in texts if t and len(t) < 1 << 20 for w in set(WORDS.findall(t.lower())) for i in range(0, len(w), LONGEST)})
            for text in texts:
                totals = scorer.totals(text) if scorer and text else None
                if totals is None:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                best = int(totals.argmax())
                names.append(model.languages[best]), scores.append(float(1 / np.exp(totals - totals[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
