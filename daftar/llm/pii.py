"""Personal data: proposed spans, judged by boosted trees.

Base rules find addresses, numbers and the like whose format leaves no doubt; they always
count. Loose generators propose further, overlapping spans: written-out addresses, numbers
with unusual separators or digits missing. Trees score each by its format and its context;
they learn from the base findings of a sample of documents against the proposals of the loose
generators there that no base rule confirms. Addresses and accounts that base rules do not know
are never taught as wrong: an address is shown to the trees with its at and dot signs put in, an
account number that passes its check counts as right, others are left out. Scores are calibrated on held-out documents, and each generator's
threshold is the lowest one that keeps its precision there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import boosting
from daftar.llm.shared import bounded_sample, small_batches

SAMPLE_DOCS = 4000  # documents with a digit or an @ sign that the trees learn from
SAMPLE_SPANS = 20_000  # proposals kept of them
SAMPLE_CHARS = 20_000  # longer texts are cut into pieces for learning
PRECISION = 0.98

# Kinds of the base findings in their order, and the patterns' parts.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GENERATORS = {
    "number": re.compile(r"\+?\(?[0-9][0-9\x20()./-]{5,40}[0-9]"),
    "digits": re.compile(r"[0-9]{7,40}"),
    "dotted": re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"),
}
# (a dot with a gap on one side only ends a sentence)
_WRITTEN = re.compile(r"[\w.+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[\w-]{1,64}(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?)[\w-]{1,63}){1,4}")
PROPOSED = (*_GENERATORS, "written")
_ACCOUNT, _ADDRESS = PROPOSED.index("account"), PROPOSED.index("written")
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?")
_DOT = re.compile(r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20\.\x20")
_CUES = ("mail", "phone", "tel", "call", "card", "account", "iban", "ssn", "address", "contact", "ip ")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str, int]  # start, order of kind, kind, end


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _account_checks(account: str) -> bool:
    """Whether an account number (IBAN) has the right check digits."""
    bare = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @ sign; what a backtracking pattern finds, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """Base findings by start, then kind. A null text has none."""
    text = text or ""
    out = [(s, 0, "email", e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of all generators, overlapping ones included: start, end, number of the generator."""
    out = []
    if _DIGIT.search(text):
        for n, pattern in enumerate(_GENERATORS.values()):
            out += [(m.start(), m.end(), n) for m in pattern.finditer(text)]
    if "@" in text or "(at)" in text or "[at]" in text:
        out += [(m.start(), m.end(), len(_GENERATORS)) for m in _WRITTEN.finditer(text)]
    return out


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format of a span, and what stands before and after it."""
    body = text[start:end]
    checks = None
    if generator == _ACCOUNT:
        body, checks = body.replace(" ", ""), _account_checks(body)
    elif generator == _ADDRESS:
        body = _DOT.sub(".", _AT.sub("@", body, count=1))
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 8]
    digits = re.sub("[^0-9]", "", body)
    groups = re.findall("[0-9]+", body)
    left, right = before[-1:], after[:1]
    return [
        generator, len(body), len(digits), len(digits) / len(body), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        body.count("."), body.count("-"), body.count(" "), body.count("("), body.startswith("+"), "@" in body, sum(map(str.isalpha, body)),
        max((min(int(g[:6]), 999) for g in groups), default=0), bool(digits) and _luhn(digits) if checks is None else checks, len(set(digits)),
        left.isalnum(), left in "\"'=:/#", right.isalnum(), right in "\"'", left.isspace(), right.isspace(), right in ".,;:!?",
        *[cue in before for cue in _CUES],
    ]


@dataclass(frozen=True)
class Judge:
    trees: boosting.Trees
    slope: float
    offset: float
    thresholds: tuple[float, ...]  # per generator; above 1 where no threshold is precise enough

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.offset, -30, 30)))


class Taken:
    """The spans of a text: base findings, and added ones, which never overlap each other."""

    def __init__(self, text: str, base: list[Span]):
        self.text, self.base, self.added = text, base, []
        self.starts = [s for s, *_ in base]
        # the furthest end so far tells where to stop looking back
        self.reach = list(accumulate((e for *_, e in base), max))

    def met(self, s: int, e: int) -> list[Span]:
        """Base findings that overlap a span."""
        out, at = [], bisect_left(self.starts, e) - 1
        while at >= 0 and self.reach[at] > s:
            if self.base[at][3] > s:
                out.append(self.base[at])
            at -= 1
        return out

    def bars(self, s: int, e: int, g: int) -> bool:
        """Whether a proposal overlaps an added span, or base findings, unless it is an account that checks and contains them."""
        at = bisect_left(self.added, (e,)) - 1
        if at >= 0 and self.added[at][3] > s:
            return True
        met = self.met(s, e)
        whole = all(s <= span[0] and span[3] <= e for span in met)
        return bool(met) and not (whole and g == _ACCOUNT and _account_checks(self.text[s:e]))

    def add(self, span: Span) -> None:
        insort(self.added, span)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals of documents with their features and whether a base finding covers the same characters.

    Of addresses and accounts apart from base findings only accounts that check are taken, as right ones.
    """
    for batch in batches:
        out: list[tuple] = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = [(s, e) for s, _, _, e in base_spans(text)]
            for nth, (s, e, g) in enumerate(proposals(text)):
                shared = max((min(e, b) - max(s, a) for a, b in base), default=0)
                whole = any(a <= s + 2 and e <= b + 2 and shared >= 0.8 * (b - a) for a, b in base)
                if g in (_ACCOUNT, _ADDRESS) and not whole:
                    checked = g == _ACCOUNT and _account_checks(text[s:e])
                    if not checked and (g == _ACCOUNT or shared <= 0):
                        continue
                    whole = checked
                out.append((h, nth, features(text, s, e, g), float(whole)))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "nth", "x", "y"])


def learn(docs: DataFrame) -> Judge | None:
    """Fit trees, calibration and thresholds on a bounded sample; None if it shows only one side."""
    # longer texts are cut into pieces, so that every text can be drawn and what is drawn is bounded
    parts = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"(?s).{{1,{SAMPLE_CHARS}}}"), F.lit(0))
    usable = docs.select(F.explode(parts).alias("text")).select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike("[0-9@]"))
    # distinct pieces: their hashes are drawn first, so that copies neither fill nor thin the sample
    drawn = bounded_sample(usable.select("h").distinct(), SAMPLE_DOCS, "h")
    sample = usable.join(F.broadcast(drawn), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    rows = sample.select("h", "text").mapInArrow(_sampled, "h long, nth long, x array<double>, y double")
    table = rows.orderBy("h", "nth").limit(SAMPLE_SPANS).toArrow()
    if not table.num_rows:
        return None
    held, y = table.column("h").to_numpy() % 5 == 0, table.column("y").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    if min(y[~held].sum(), (1 - y[~held]).sum(), held.sum()) < 10:
        return None
    trees = boosting.train(x[~held], y[~held])
    slope, offset = boosting.platt(trees.margin(x[held]), y[held])
    judge = Judge(trees, slope, offset, ())
    p, thresholds = judge.probability(x[held]), []
    for g in range(len(PROPOSED)):
        mine = np.flatnonzero(x[held][:, 0] == g)
        mine = mine[np.argsort(-p[mine], kind="stable")]
        precise = np.cumsum(y[held][mine]) / np.arange(1, len(mine) + 1) >= PRECISION
        # ties share a fate: the threshold stands at the last precise place; without any wrong one
        # among addresses or accounts, no score is too low to be precise
        lowest = float(p[mine][np.flatnonzero(precise)[-1]]) if precise.any() else 2.0
        thresholds.append(0.0 if g in (_ACCOUNT, _ADDRESS) and y[held][mine].all() else lowest)
    return Judge(trees, slope, offset, tuple(max(t, 0.5) for t in thresholds))


def all_spans(texts: list[str | None], judge: Judge | None) -> list[tuple[list[Span], list[Span]]]:
    """Base findings and all findings of each text; added ones overlap neither a base finding nor a better one.

    Only an account number that checks may contain base findings.
    """
    found, rows, where = [], [], []
    for i, text in enumerate(texts):
        found.append(Taken(text or "", base_spans(text)))
        if judge is not None:
            for s, e, g in proposals(text or ""):
                if not found[-1].bars(s, e, g):
                    rows.append(features(text or "", s, e, g)), where.append((i, s, e, g))
    if rows:
        p = judge.probability(np.array(rows, dtype=float))
        for j in np.argsort(-p, kind="stable"):
            i, s, e, g = where[j]
            if p[j] >= judge.thresholds[g] and not found[i].bars(s, e, g):
                found[i].add((s, len(KINDS) + g, PROPOSED[g], e))
    return [(t.base, sorted(t.base + t.added)) for t in found]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base findings, ``base_sha256``, ``spans`` for every row of ``docs`` (doc_id, text).

    A null text counts as empty and has no spans. Rows are judged one by one, so repeated
    rows and null ids give a row each; an empty table gives an empty table. Texts of any length
    are searched whole. Columns besides doc_id and text are not looked at.
    """
    small_batches(docs.sparkSession)
    judge = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(batch.column(1).to_pylist(), judge)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([spans_text(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, every], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all findings in ``text`` replaced, other columns and null texts as they are."""
    small_batches(docs.sparkSession)
    judge, names = learn(docs), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [redacted(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, judge), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
