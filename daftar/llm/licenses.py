"""Licence wording by templates with markup, compiled into one token automaton.

A template is a text in which ``<<beginOptional>> … <<endOptional>>`` marks wording that may be
missing and ``<<var;words="m-n">>`` a place where m to n words of any kind may stand;
``<<var;match="a b|c">>`` allows one of some phrases. All the rest is mandatory and has to match
word for word. Words are what the licence query calls words, so case, punctuation and line breaks
never matter.

All templates are compiled together. A text is read once, word by word; the sets of places that
are alive at once become the states of a deterministic automaton, made when first met and
forgotten when there are too many of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.shared import small_batches

# fixed values: the phrases and labels of the base rules
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# fixed values: wording of licences and of the notices that point to them
TEMPLATES = [
    ("mit-notice", """<<var;match="released|licensed|distributed|available|is">> under <<beginOptional>> the terms of <<endOptional>>
        <<var;match="the|an">> <<beginOptional>> open source <<endOptional>> MIT <<var;match="license|licence">>"""),
    ("apache-2.0-notice", """licensed under <<beginOptional>> the terms of <<endOptional>> the Apache License, Version 2.0"""),
    ("gpl-notice", """<<var;match="released|licensed|distributed|available">> under <<beginOptional>> the terms of <<endOptional>>
        the <<beginOptional>> GNU <<endOptional>> <<beginOptional>> <<var;match="lesser|affero|library">> <<endOptional>>
        General Public License <<beginOptional>> as published by the Free Software Foundation, either <<endOptional>>
        version <<var;match="1|2|3|2.1">>"""),
    ("cc-notice", """licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> the <<endOptional>>
        <<var;match="CC|Creative Commons">> <<var;match="BY|BY-NC|BY-SA|BY-ND|BY-NC-SA|BY-NC-ND|Attribution|Attribution-NonCommercial|Attribution-ShareAlike">>
        <<var;match="1.0|2.0|2.5|3.0|4.0">>"""),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<beginOptional>> (including the next paragraph) <<endOptional>> shall be included in all copies
        or substantial portions of the Software."""),
    ("isc-text", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies."""),
    ("bsd-2-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<beginOptional>> 1. <<endOptional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. <<beginOptional>> 2. <<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-text", """other materials provided with the distribution. <<beginOptional>> 3. <<endOptional>> Neither the name of
        <<var;words="1-12">> nor the names of <<beginOptional>> its <<endOptional>> <<beginOptional>> the <<endOptional>>
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission."""),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at <<var;words="0-8">> Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied."""),
    ("gpl-header", """<<var;words="1-6">> is free software: you can redistribute it and/or modify it under the terms
        of the GNU <<beginOptional>> <<var;match="lesser|affero|library">> <<endOptional>> General Public License as published by
        the Free Software Foundation, either version <<var;match="1|2|3|2.1">> <<beginOptional>> of the License
        <<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>."""),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("bsl-1.0-header", """Distributed under the Boost Software License, Version 1.0."""),
    ("unlicense-text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("zlib-text", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions:"""),
]

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD)
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
STATES = 20_000  # kept of the deterministic automaton; beyond, it is built anew
USUAL = 4  # mandatory words at which the score is one half


def words(text: str | None) -> Iterator[bytes]:
    """The words of a text, A-Z lower-cased, one at a time."""
    # bytes of letters beyond ASCII are 0x80 and above, and lower() leaves them alone
    return (m[0] for m in _WORDS.finditer((text or "").encode("utf-8", "surrogatepass").lower()))


@dataclass(frozen=True)
class Optional:
    inner: tuple


@dataclass(frozen=True)
class Replaceable:
    least: int
    most: int


@dataclass(frozen=True)
class OneOf:
    phrases: tuple


def parse(template: str) -> tuple:
    """A template as a sequence of words (bytes), Optional, Replaceable and OneOf parts."""
    stack: list[list] = [[]]
    for nth, piece in enumerate(_MARKUP.split(template)):
        if nth % 2 == 0:
            stack[-1].extend(words(piece))
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = tuple(stack.pop())
            stack[-1].append(Optional(inner))
        elif found := re.search(r'words="(\d+)-(\d+)"', piece):
            stack[-1].append(Replaceable(int(found[1]), int(found[2])))
        elif found := re.search(r'match="([^"]*)"', piece):
            phrases = tuple(dict.fromkeys(tuple(words(p)) for p in found[1].split("|")))
            if any(phrases):  # of punctuation alone nothing is left to match
                stack[-1].append(OneOf(phrases))
        else:
            raise ValueError(f"markup not known: {piece}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(stack[0])


def mandatory(parts: tuple) -> int:
    """How many words every accepted text has."""
    size = {Optional: lambda p: 0, Replaceable: lambda p: p.least, OneOf: lambda p: min(map(len, p.phrases)), bytes: lambda p: 1}
    return sum(size[type(p)](p) for p in parts)


class Automaton:
    """All templates as one automaton over words that reports where any of them ends."""

    def __init__(self, templates: Iterable[tuple[str, str]]):
        self.labels: list[str] = []
        self.parts: list[tuple] = []
        self._by_word: list[dict[bytes, list[int]]] = []
        self._by_any: list[list[int]] = []
        self._free: list[list[int]] = []  # moves that read no word
        self._ends: dict[int, int] = {}
        begin = self._node()
        for label, template in templates:
            self.labels.append(label)
            self.parts.append(parse(template))
            if not mandatory(self.parts[-1]):
                raise ValueError(f"the template {label} has no mandatory words")
            self._ends[self._chain(begin, self.parts[-1])] = len(self.labels) - 1
        self._begin = self._closure([begin])
        self._numbers = {w: n for n, w in enumerate(sorted({w for step in self._by_word for w in step}), 1)}
        self._named = [b"", *sorted(self._numbers, key=self._numbers.get)]
        self._forget()

    def _node(self) -> int:
        self._by_word.append({})
        self._by_any.append([])
        self._free.append([])
        return len(self._free) - 1

    def _chain(self, at: int, parts: Iterable) -> int:
        """Nodes for these parts after ``at``; gives the last."""
        for part in parts:
            if isinstance(part, bytes):
                then = self._node()
                self._by_word[at].setdefault(part, []).append(then)
            elif isinstance(part, Optional):
                then = self._node()
                self._free[at].append(then)
                self._free[self._chain(self._fresh(at), part.inner)].append(then)
            elif isinstance(part, OneOf):
                then = self._node()
                for phrase in part.phrases:
                    self._free[self._chain(self._fresh(at), phrase)].append(then)
            else:
                steps = [at := self._fresh(at)]
                for _ in range(part.most):
                    steps.append(self._node())
                    self._by_any[steps[-2]].append(steps[-1])
                then = self._node()
                for node in steps[part.least :]:
                    self._free[node].append(then)
            at = then
        return at

    def _fresh(self, at: int) -> int:
        node = self._node()
        self._free[at].append(node)
        return node

    def _closure(self, nodes: Iterable[int]) -> frozenset[int]:
        seen, todo = set(), list(nodes)
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo.extend(self._free[node])
        return frozenset(seen)

    def _forget(self) -> None:
        self._known: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._moves: list[dict[int, int]] = []
        self._found: list[tuple[int, ...]] = []
        self._state(self._begin)

    def _state(self, nodes: frozenset[int]) -> int:
        if nodes not in self._known:
            self._known[nodes] = len(self._sets)
            self._sets.append(nodes)
            self._moves.append({})
            self._found.append(tuple(sorted(self._ends[n] for n in nodes if n in self._ends)))
        return self._known[nodes]

    def _move(self, state: int, number: int) -> int:
        if len(self._sets) > STATES:
            nodes = self._sets[state]
            self._forget()
            state = self._state(nodes)
        then, word = set(), self._named[number]
        for node in self._sets[state]:
            then.update(self._by_any[node])
            then.update(self._by_word[node].get(word, ()) if number else ())
        to = self._state(self._closure(then) | self._begin)
        self._moves[state][number] = to
        return to

    def ends(self, text: str | None) -> tuple[int, list[tuple[int, int]]]:
        """The number of words, and (template, index of its last word) wherever one ends, in order."""
        out, state, nth, number = [], 0, -1, self._numbers.get
        for nth, word in enumerate(words(text)):
            n = number(word, 0)
            to = self._moves[state].get(n)
            state = self._move(state, n) if to is None else to
            if self._found[state]:
                out.extend((t, nth) for t in self._found[state])
        return nth + 1, out


PLACES = "n_words long, base array<struct<label:string,start:long>>, own array<struct<label:string,ends:array<long>>>, score double"
_TYPES = [
    pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])),
    pa.list_(pa.struct([("label", pa.string()), ("ends", pa.list_(pa.int64()))])), pa.float64(),
]


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*BASE, *templates])
        sizes = [mandatory(p) for p in automaton.parts]
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                n, ends = automaton.ends(text)
                base = [{"label": BASE[t][0], "start": at - sizes[t] + 1} for t, at in ends if t < len(BASE)]
                own: dict[str, list[int]] = {}
                for t, at in ends:
                    if t >= len(BASE):
                        own.setdefault(automaton.labels[t], []).append(at)
                most = max((sizes[t] for t, _ in ends), default=0)
                for column, value in zip(rows, (n, base, [{"label": k, "ends": v} for k, v in sorted(own.items())], most / (most + USUAL)), strict=True):
                    column.append(value)
            new = [pa.array(c, t) for c, t in zip(rows, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["kept", "n_words", "base", "own", "score"])

    return run


def scan(docs: DataFrame, *keep: str, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` as ``kept`` and what its texts hold of the templates.

    ``n_words``; ``base`` (label and first word of every place of a base phrase, words counted from
    0, in the order of their ends); ``own`` (for each accepted template its label and the last words
    of its places); ``score``: m / (m + 4), where m is the most mandatory words of any accepted phrase
    or template, so a mention scores low and a full licence text near 1.

    A null text counts as empty, which has no words and no places; a text of any length is read
    whole, one word at a time. Rows are independent, so repeated rows give repeated results, null
    identifiers stay null, and an empty table gives an empty one. ``kept`` is a struct, so no column
    of ``docs`` can clash with the results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("__text"))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, {PLACES}"
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), schema)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` of every row."""
    base = lambda c: F.col("base").getField(c)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(docs, "doc_id").select(
        "kept.doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(base("start")).alias("first_word"), F.array_max(base("start")).alias("last_word"),
        joined(base("label")).alias("base_labels"), joined(F.concat(base("label"), F.col("own").getField("label"))).alias("labels"), "score",
    )


def as_pattern(parts: tuple) -> str:
    """The same wording as a regular expression over words that are each followed by one space."""
    out = ""
    for part in parts:
        if isinstance(part, bytes):
            out += re.escape(part.decode()) + " "
        elif isinstance(part, Optional):
            out += f"(?:{as_pattern(part.inner)})?"
        elif isinstance(part, OneOf):
            out += "(?:" + "|".join(as_pattern(p) for p in part.phrases) + ")"
        else:
            out += "(?:[^ ]+ ){%d,%d}" % (part.least, part.most)
    return out


def find_sql() -> str:
    """SQL for the rows of ``find``: places of phrases by position, templates as regular expressions."""
    parts = {label: parse(t) for label, t in TEMPLATES}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = lambda phrase: " AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(phrase.split(), 1))
    base = ", ".join(f"list_filter(range(len(w)), lambda i: {at(p)}) AS b_{label}" for label, p in BASE)
    own = ", ".join(f"""regexp_matches(s, ' {as_pattern(p)}') AS "o_{label}\"""" for label, p in parts.items())
    names = [(label, f"len(b_{label}) > 0", len(p.split())) for label, p in BASE]
    mine = [(label, f'"o_{label}"', mandatory(p)) for label, p in parts.items()]
    listed = lambda some: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for x, c, _ in some) + "], lambda x: x IS NOT NULL)), ',')"
    most = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {m} ELSE 0 END" for _, c, m in names + mine) + ")"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {base} FROM d),
    o AS (SELECT *, {own}, list_concat({", ".join(f"b_{label}" for label, _ in BASE)}) AS b FROM b)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base,
           CAST(list_min(b) AS BIGINT) AS first_word, CAST(list_max(b) AS BIGINT) AS last_word,
           {listed(names)} AS base_labels, {listed(names + mine)} AS labels,
           CAST({most} AS DOUBLE) / ({most} + {USUAL}) AS score
    FROM o"""
