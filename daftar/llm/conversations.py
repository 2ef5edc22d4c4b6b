"""Repair of conversation structure by the cheapest edits, as a secondary-sorted stream.

Rows are dealt out by conversation, sorted by turn inside each partition, and read once. Per
conversation a step of the dynamic program is carried from row to row and from Arrow batch to Arrow
batch: for each of four states (what was emitted last: nothing, system, user, assistant) the least
cost, the order of the states' audits, and a running digest of the conversation repaired that way.
None of it grows with the conversation. What grows is three bytes of backpointers per row; they
leave the task as rows of their own whenever ``SEGMENT`` of them are held, and a second stream reads
them last to first to write out the audits of such giant conversations.

Why the order of audits can be carried: an audit that has read the same rows and does not end in an
insertion is never a proper prefix of another, so two of them differ at some character already, and
what follows cannot change which is less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.llm.shared import small_batches, stage

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = 1 << 18  # rows whose backpointers are held before they are written out
BATCH = 2000
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs; a truncated row that stays adds the last
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or reroled row becomes
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_PAIRS = {"su", "ua", "au"}
_ENDS = frozenset(".!?")
_WHITE = " \t\n\v\f\r"
_ACTIONS = " DKR"
_LONGEST = (1 << 63) - 1


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _AFTER[state]
    return state


def advance(costs: tuple, ranks: tuple, initial: str, must_go: bool, cut_off: bool) -> tuple[tuple, tuple, tuple, int]:
    """One row read: new costs and ranks by state, the move that led to each, and all moves packed in 24 bits.

    A move is (state before, insertions before the row, action); costs are None for states out of
    reach. More than two insertions in a row lead nowhere that fewer do not.
    """
    best: list[tuple | None] = [None] * 4
    stays = CUT_OFF if cut_off else 0
    for state in range(4):
        if costs[state] is None:
            continue
        for n in range(3):
            middle = _inserted(state, n)
            paid = costs[state] + n * INSERT
            options = [("D", middle, paid + DELETE)]
            if not must_go:
                options.append(("R", _AFTER[middle], paid + REROLE + stays))
                if (middle, initial) in _LEGAL:
                    options.append(("K", _LEGAL[middle, initial], paid + KEEP + stays))
            for action, to, cost in options:
                offer = (cost, ranks[state], "I" * n + action, state, n, action)
                if best[to] is None or offer < best[to]:
                    best[to] = offer
    order = sorted((b[1:3], to) for to, b in enumerate(best) if b)
    rank = [0] * 4
    for nth, (_, to) in enumerate(order):
        rank[to] = nth
    moves = tuple(b and b[3:] for b in best)
    code = sum((m[0] | m[1] << 2 | _ACTIONS.index(m[2]) << 4) << 6 * to for to, m in enumerate(moves) if m)
    return tuple(b and b[0] for b in best), tuple(rank), moves, code


def finish(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """After the last row: the least cost, the state it comes from, and the insertions at the end."""
    ends = [(costs[s] + n * INSERT, ranks[s], "I" * n, s, n) for s in range(4) if costs[s] is not None for n in range(3)
            if _inserted(s, n) == ASSISTANT or (s, n) == (NOTHING, 0)]
    cost, _, _, state, n = min(ends)
    return cost, state, n


def walk_back(codes: np.ndarray, state: int) -> tuple[str, int]:
    """The audit of these rows when ``state`` holds after the last, and the state before the first."""
    out = []
    for code in codes[::-1].tolist():
        move = code >> 6 * state
        out.append(_ACTIONS[move >> 4 & 3] + "I" * (move >> 2 & 3))
        state = move & 3
    return "".join(out)[::-1], state


class Repair:
    """The state carried through one conversation."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = None  # turns
        self.distinct = 0
        self.initial: str | None = None  # of the row before
        self.paid, self.costs, self.ranks = 0, (0, None, None, None), (0, 0, 0, 0)
        self.repaired: list = [(hashlib.sha256(), True), None, None, None]
        self.codes: list[int] = []
        self.segment = 0

    def read(self, turn: int | None, role: str, text: str, again: bool, memo: dict) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        self.counts["illegal"] += self.initial is not None and self.initial + initial not in _PAIRS
        self.initial = initial
        end = text.rstrip(_WHITE)[-1:]
        cut_off = not again and end != "" and end not in _ENDS
        self.counts["blank"] += end == ""
        self.counts["duplicate"] += end != "" and again
        self.counts["truncated"] += cut_off
        key = (self.costs, self.ranks, initial if initial in "sua" else "", end == "" or again, cut_off)
        step = memo.get(key)
        if step is None:
            costs, ranks, moves, code = advance(*key)
            least = min(c for c in costs if c is not None)
            step = memo[key] = (tuple(c if c is None else c - least for c in costs), ranks, moves, code, least)
        self.costs, self.ranks, moves, code, least = step
        self.paid += least
        self.codes.append(code)
        self.repaired = [m and self._emitted(m, role, text) for m in moves]

    def _emitted(self, move: tuple, role: str, text: str) -> tuple:
        """The digest of the repaired rows after this move, and whether there are none."""
        state, n, action = move
        rows = []
        for _ in range(n):
            state = _AFTER[state]
            rows.append(_ROLE[state] + ":")
        if action != "D":
            rows.append((role if action == "K" else _ROLE[_AFTER[state]]) + ":" + text)
        return self._hashed(*self.repaired[move[0]], rows)

    @staticmethod
    def _hashed(digest, none: bool, rows: list[str]) -> tuple:
        if not rows:
            return digest, none
        digest = digest.copy()
        digest.update(("" if none else "\n").encode() + "\n".join(rows).encode("utf-8", "surrogatepass"))
        return digest, False

    def spill(self) -> dict:
        """The backpointers held, as a row; the next ones start a new segment."""
        packed = np.array(self.codes, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        self.codes, self.segment = [], self.segment + 1
        return {"conv": self.conv, "segment": self.segment - 1, "packed": packed}

    def end(self) -> Iterator[dict]:
        cost, state, n = finish(self.costs, self.ranks)
        digest, none = self.repaired[state]
        rows, last = [], state
        for _ in range(n):
            last = _AFTER[last]
            rows.append(_ROLE[last] + ":")
        digest, _ = self._hashed(digest, none, rows)
        gaps = 0 if self.first is None else min(_LONGEST, self.last - self.first + 1 - self.distinct)
        known = {"conv": self.conv, "gaps": gaps, **self.counts, "cost": self.paid + cost, "repaired_sha256": digest.hexdigest()}
        if self.segment:  # a giant: its audit is written by the second stream
            if self.codes:
                yield self.spill()
            yield known | {"segment": self.segment, "state": state, "audit": "I" * n}
        else:
            yield known | {"audit": walk_back(np.array(self.codes, dtype=np.int64), state)[0] + "I" * n}


STREAMED = f"conv string, segment long, packed binary, state int, {RESULT}"
_COLUMNS = [c.split()[0] for c in STREAMED.split(", ")]
_COUNTS = ["segment", "state", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_MEMO = 100_000  # steps kept; costs are relative, so there are few


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype(dict.fromkeys(_COUNTS, "Int64"))


def _stream(segment: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Repair | None = None
        memo: dict = {}
        for frame in frames:
            out: list[dict] = []
            for conv, gone, no_turn, turn, role, text, again in frame.itertuples(index=False, name=None):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.extend(now.end())
                    now = Repair(conv)
                if not gone:
                    now.read(None if no_turn else turn, role, text, again, memo)
                    if len(now.codes) >= segment:
                        out.append(now.spill())
            if len(memo) > _MEMO:
                memo.clear()
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame(list(now.end()))

    return run


PIECES = "conv string, segment long, piece string"


def _audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of giant conversations' audits, from their segments last to first."""
    state = 0
    for frame in frames:
        out = []
        for conv, segment, packed, end, tail in frame.itertuples(index=False, name=None):
            if packed is None:  # the end of a conversation comes before its segments
                state, piece = int(end), tail
            else:
                wide = np.zeros((len(packed) // 3, 4), dtype=np.uint8)
                wide[:, :3] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 3)
                piece, state = walk_back(wide.view("<u4").ravel(), state)
            out.append((conv, segment, piece))
        yield pd.DataFrame(out, columns=["conv", "segment", "piece"])


def _sorted_rows(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows by conversation and turn; the partitioning by conversation serves both sorts."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.coalesce(gone, F.lit(False)).alias("gone"), F.col("turn").isNull().alias("no_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
    )
    same = W.partitionBy("conv", "gone", "role", "text").orderBy(F.desc("no_turn"), "turn")
    rows = rows.repartition("conv").withColumn("again", F.row_number().over(same) > 1)
    return rows.sortWithinPartitions("conv", F.desc("no_turn"), "turn", "role", "text")


def repair(rows: DataFrame, gone: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """The cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text).

    One row per conv_id: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` (initials of the edits: Keep, Rerole, Delete, Insert) and ``repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn by role, then text, so repeated rows
    are neighbours and all but the first of them duplicates. Null roles and texts count as one
    space. Rows for which ``gone`` holds only say that a conversation exists; one without other
    rows has zeros, an empty audit and the digest of the empty string. Rows with a null conv_id are
    one conversation. A gap beyond the range of a long is held at its end. Texts of any length are
    read whole; a conversation of any length is streamed through one task, which holds no more than
    a batch of it and ``segment`` backpointers. An empty table gives an empty table. Other columns
    are not looked at.
    """
    small_batches(rows.sparkSession, BATCH)
    kind = rows.schema["conv_id"].dataType
    ordered = _sorted_rows(rows, F.lit(False) if gone is None else gone)
    done = stage(ordered.mapInPandas(_stream(segment), STREAMED), "conversation-repairs")
    names = [c.split()[0] for c in RESULT.split(", ")]
    small = done.filter("segment is null").select("conv", *names)
    parts = done.filter("segment is not null")
    back = parts.select("conv", "segment", "packed", "state", "audit").repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
    pieces = back.mapInPandas(_audits, PIECES).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "piece"))).alias("p"))
    audits = pieces.select(F.col("conv").alias("of"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("whole"))
    giant = parts.filter("packed is null").join(audits, F.col("conv").eqNullSafe(F.col("of"))).withColumn("audit", F.col("whole")).select("conv", *names)
    return small.union(giant).select(F.col("conv").cast(kind).alias("conv_id"), *names)


REPAIRED = "conv string, place long, role string, text string, edit string"


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of repaired conversations; the audit of each conversation comes before its rows."""
    edits: Iterator[str] = iter("")
    conv, place, state = None, 0, NOTHING
    for frame in frames:
        out: list[tuple] = []
        for conv, is_row, role, text, audit in frame.itertuples(index=False, name=None):
            if not is_row:
                edits, place, state = iter(audit), 0, NOTHING
                rows = len(audit) - audit.count("I")
            for edit in edits if is_row or not rows else ():
                if edit == "I":
                    state = _AFTER[state]
                    out.append((conv, place, _ROLE[state], "", edit))
                elif edit == "K":
                    state = _LEGAL[state, role[:1]]
                    out.append((conv, place, role, text, edit))
                elif edit == "R":
                    state = _AFTER[state]
                    out.append((conv, place, _ROLE[state], text, edit))
                place += edit != "D"
                if edit != "I":
                    rows -= 1
                    if rows:
                        break
        yield pd.DataFrame(out, columns=["conv", "place", "role", "text", "edit"])


def repaired_rows(rows: DataFrame, repairs: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 0), ``role``, ``text``, ``edit``, by streaming the audits over the rows."""
    small_batches(rows.sparkSession, BATCH)
    kind = rows.schema["conv_id"].dataType
    keys = ["no_turn", "turn", "role", "text"]
    mine = _sorted_rows(rows, F.lit(False) if gone is None else gone).filter(~F.col("gone"))
    mine = mine.select("conv", F.lit(True).alias("is_row"), *keys, F.lit(None).cast("string").alias("audit"))
    audits = repairs.select(
        F.col("conv_id").cast("string").alias("conv"), F.lit(False).alias("is_row"), F.lit(False).alias("no_turn"), F.lit(0).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text"), "audit",
    )
    both = mine.union(audits).repartition("conv").sortWithinPartitions("conv", "is_row", F.desc("no_turn"), "turn", "role", "text")
    out = both.select("conv", "is_row", "role", "text", "audit").mapInPandas(_apply, REPAIRED)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "place", "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by crc32 of ``conv_id:turn``; lost rows stay with ``gone`` set.

    A null counts as one space, in the checksum and as role or text.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    gone = F.col("fault") == 0
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv_id", "turn", F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), times.alias("nth")
    ).drop("nth")


# every move of the rules above, stated again for SQL: state, insertions, what they emit, state after them
_MOVES = ", ".join(
    f"('{a}', {n}, '{lines}', '{b}')"
    for a, n, lines, b in [
        ("E", 0, "", "E"), ("E", 1, "user:", "U"), ("E", 2, "user:|assistant:", "A"), ("S", 0, "", "S"), ("S", 1, "user:", "U"),
        ("S", 2, "user:|assistant:", "A"), ("U", 0, "", "U"), ("U", 1, "assistant:", "A"), ("A", 0, "", "A"), ("A", 1, "user:", "U"),
        ("A", 2, "user:|assistant:", "A"), ("U", 2, "assistant:|user:", "U"),
    ]
)

REPAIR_SQL = rf"""
    WITH RECURSIVE tab AS (
      SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(n))),
    src AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    f AS (
      SELECT src.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fault FROM src, tab),
    d AS (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, range(2) AS r(n) WHERE fault <> 0 AND (n = 0 OR fault = 3)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    m AS (
      SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
    mv AS (SELECT * FROM (VALUES {_MOVES}) AS v(a, n, lines, b)),
    act AS (
      SELECT * FROM (VALUES ('D', '', 'E', 'E'), ('D', '', 'S', 'S'), ('D', '', 'U', 'U'), ('D', '', 'A', 'A'),
        ('K', 's', 'E', 'S'), ('K', 'u', 'E', 'U'), ('K', 'u', 'S', 'U'), ('K', 'a', 'U', 'A'), ('K', 'u', 'A', 'U'),
        ('R', '', 'E', 'U'), ('R', '', 'S', 'U'), ('R', '', 'U', 'A'), ('R', '', 'A', 'U')) AS v(e, c, x, y)),
    st AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
      FROM (SELECT DISTINCT conv_id FROM src)
      UNION ALL
      SELECT conv_id, i, s, cost, audit, lines FROM (
        SELECT st.conv_id, st.i + 1 AS i, act.y AS s,
               st.cost + 2 * mv.n + CASE act.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act.e <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
               st.audit || repeat('I', mv.n) || act.e AS audit,
               list_concat(list_concat(st.lines, list_filter(string_split(mv.lines, '|'), lambda x: x <> '')),
                 CASE act.e WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text]
                            ELSE [CASE act.y WHEN 'U' THEN 'user' ELSE 'assistant' END || ':' || m.text] END) AS lines
        FROM st JOIN m ON m.conv_id IS NOT DISTINCT FROM st.conv_id AND m.i = st.i + 1 JOIN mv ON mv.a = st.s
        JOIN act ON act.x = mv.b AND (act.e <> 'K' OR act.c = m.c) AND (act.e = 'D' OR m.fault NOT IN ('blank', 'duplicate')))
      QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
    size AS (
      SELECT conv_id, count(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT DISTINCT conv_id AS id FROM src) LEFT JOIN m ON conv_id IS NOT DISTINCT FROM id GROUP BY conv_id),
    fin AS (
      SELECT st.conv_id, cost + 2 * n AS cost, audit || repeat('I', n) AS audit,
             list_concat(st.lines, list_filter(string_split(mv.lines, '|'), lambda x: x <> '')) AS lines
      FROM st JOIN mv ON mv.a = st.s AND (mv.b = 'A' OR (mv.a = 'E' AND mv.n = 0))
      WHERE st.i = coalesce((SELECT max(i) FROM m WHERE m.conv_id IS NOT DISTINCT FROM st.conv_id), 0)
      QUALIFY row_number() OVER (PARTITION BY st.conv_id ORDER BY cost + 2 * n, audit || repeat('I', n)) = 1)
    SELECT fin.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
           sha256(array_to_string(lines, chr(10))) AS repaired_sha256
    FROM fin LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM fin.conv_id"""
