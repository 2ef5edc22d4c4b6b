"""SentencePiece BPE by a prefix table, and its inverse.

The encoding of every prefix of a text ends in exactly one token. An automaton over the
vocabulary gives all pieces that end at a position; the one among them that is compatible
with the last token of the prefix before it is the prefix's last token. Two tokens are
compatible if merging the two pieces' characters gives those two tokens back. One pass fills
the table, and the ids are read off backwards.

Text is cut only where no piece of the vocabulary can reach across, so equal stretches
(words, mostly) are encoded once per worker and looked up after that.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daftar.llm.shared import small_batches

SPACE = "▁"  # how pieces write a space
SEGMENT = 1 << 20  # characters of a text encoded at a time
REMEMBERED = 400_000  # stretches, and pairs of pieces, that a worker keeps: some 100 MB, from one task to the next
LONGEST_KEPT = 48  # characters of a stretch that is kept
_NONE = -1


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds: pieces with ids and scores, the ids of bytes, and the special ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    first_byte: int
    normal: tuple[int, ...]
    special: tuple[int, ...]
    begin: int
    end: int


def load(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback, identity normalization and a dummy prefix."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = tuple(i for i in ids if model.is_control(i) or model.is_unknown(i))
    at_byte = tuple(i for i in ids if model.is_byte(i))
    if len(at_byte) != 256 or at_byte != tuple(range(at_byte[0], at_byte[0] + 256)):
        raise ValueError("the model has no byte fallback")
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), at_byte[0],
        tuple(i for i in ids if i not in set(special) | set(at_byte)), special, model.bos_id(), model.eos_id(),
    )


class _Memo(dict):
    """Ids of stretches as bytes, computed when first asked for."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, stretch: str) -> bytes:
        ids = np.array(self.compute(stretch), dtype="<u4").tobytes()
        if len(stretch) <= LONGEST_KEPT:
            self[stretch] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.id_of = {v.pieces[i]: i for i in v.normal}
        self.score = v.scores
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if not self._only_spaces(piece) and self.merged(piece) == [i]:  # others never stand in an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.add_word(SPACE, (self.id_of[SPACE], 1))
        self.automaton.make_automaton()
        mixed = [p for p in self.id_of if SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and not self._only_spaces(p)]
        if mixed:
            raise ValueError(f"pieces with spaces inside: {mixed[:3]}")
        self.stretches = re.compile(self._cuts())
        self.memo = _Memo(self.encode_stretch)
        self.bytes_of = [b""] * len(v.pieces)
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            self.bytes_of[v.first_byte + b] = bytes([b])

    @staticmethod
    def _only_spaces(piece: str) -> bool:
        return not piece.strip(SPACE)

    def _cuts(self) -> str:
        """A pattern of stretches that no piece crosses: at spaces, at line ends, and between a word and punctuation."""
        inside = "".join(p for p in self.id_of if len(p) > 1)
        breaks = "".join(c for c in "\n\r\t" if c not in inside and c not in self.id_of)
        joined = {p[i] for p in self.id_of for i in range(1, len(p)) if p[i - 1].isalpha()}
        marks = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in joined)
        word = f"{SPACE}*[^\\W\\d_]+(?=[{re.escape(marks)}])|" if marks else ""
        body = f"[^{SPACE}{re.escape(breaks)}]"
        return f"{word}{SPACE}+{body}*|{body}+" + (f"|[{re.escape(breaks)}]+" if breaks else "")

    def merged(self, text: str) -> list[int]:
        """The encoding by its definition: merge the best-scored adjacent pair, the leftmost of equals, until none is left."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            whole = self.id_of.get(parts[i] + parts[j])
            if whole is not None:
                heapq.heappush(queue, (-self.score[whole], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [self.id_of.get(p, _NONE) for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pair_memo.get(pair)
        if known is None:
            if len(self.pair_memo) > REMEMBERED:
                self.pair_memo.clear()
            known = self.merged(self.v.pieces[left] + self.v.pieces[right]) == [left, right]
            self.pair_memo[pair] = known
        return known

    def _spaces(self, n: int) -> list[int]:
        """A run of spaces. Pieces of spaces have equal scores among them, so runs follow the definition."""
        if n not in self.runs:
            run = self.merged(SPACE * n)
            if n > 1000:
                return run
            self.runs[n] = run
        return self.runs[n]

    def encode_stretch(self, stretch: str) -> list[int]:
        body = stretch.lstrip(SPACE)
        spaces = len(stretch) - len(body)
        if not body:
            return self._spaces(spaces)
        if spaces < 2:
            return self.encode_word(stretch)
        # spaces merge among themselves last of all, and no piece holds two spaces and a letter
        ids = self.encode_word(SPACE + body)
        if ids[0] == self.id_of[SPACE]:
            return self._spaces(spaces) + ids[1:]
        return self._spaces(spaces - 1) + ids

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch with at most one space, which comes first."""
        n = len(word)
        last, length = [_NONE] * (n + 1), [1] * (n + 1)
        for end, (token, size) in self.automaton.iter(word):
            at = end + 1
            if last[at] == _NONE:
                previous = last[at - size]
                if at == size or previous == _NONE or self.compatible(previous, token):
                    last[at], length[at] = token, size
        ids: list[int] = []
        at = n
        while at:
            if last[at] == _NONE:  # a character without a piece: its bytes
                ids.extend(self.v.first_byte + b for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text without begin and end, as little-endian 32-bit numbers, a segment at a time."""
        at, n = 0, len(text)
        while at < n:
            end = min(at + SEGMENT, n)
            while end < n:  # a segment ends before a space that follows none
                end = text.find(" ", end)
                end = n if end < 0 else end
                if text[end - 1] not in (" ", SPACE):
                    break
                end += end < n
            part = (SPACE if at == 0 else "") + text[at:end].replace(" ", SPACE)
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            yield b"".join(map(self.memo.__getitem__, self.stretches.findall(part)))
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, begin and end included; a null text is empty."""
        ids = b"".join(self.encode_parts(text or ""))
        return np.concatenate([[self.v.begin], np.frombuffer(ids, dtype="<u4"), [self.v.end]]).astype("<u4")

    def decode_parts(self, parts: Iterator[np.ndarray]) -> Iterator[bytes]:
        """UTF-8 of consecutive ids; the first piece loses its leading space."""
        started = False
        for ids in parts:
            raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
            if not started and raw:
                started = True
                first = next(i for i in ids.tolist() if self.bytes_of[i])
                if self.v.pieces[first].startswith(SPACE):
                    raw = raw[1:]
            yield raw

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 come out as U+FFFD."""
        return b"".join(self.decode_parts(iter([np.asarray(ids)]))).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hash((vocabulary.pieces, vocabulary.scores))
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row of ``docs`` (doc_id, text).

    Ids hold begin and end. Null and empty texts give just those two and decode to the empty
    text. Texts of any length are encoded, decoded and digested a segment at a time. Rows are
    independent of each other: repeated rows and null ids are answered row by row, and an
    empty table gives an empty table. Columns besides doc_id and text are not looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (vocabulary.begin, vocabulary.end))
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids, n, decoded = hashlib.sha256(begin), 2, hashlib.sha256()

                def told(text=text, ids=ids):
                    nonlocal n
                    for part in coder.encode_parts(text or ""):
                        ids.update(part)
                        n += len(part) // 4
                        yield np.frombuffer(part, dtype="<u4")

                for raw in coder.decode_parts(told()):
                    decoded.update(raw)
                ids.update(end)
                counts.append(n), ids_sha.append(ids.hexdigest()), text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
