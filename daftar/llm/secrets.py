"""Secret scans over a ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. The ledger says which blob was
scanned under which version of which rule, and what was found. A scan takes only pairs of
blob and rule version that the ledger lacks, so copies, unchanged files and rules that did
not change cost nothing; findings reach all paths of a blob by a join.

Column functions throughout: positions are running sums over the lengths of matches and
of the pieces between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern``'s matches, leftmost and not overlapping, whose group ``group`` has at least ``least`` characters."""

    kind: str
    version: str
    hint: str  # a text without a match of this has no finding
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds, patterns and lengths of the base findings.
KEYWORDS = "password|passwd|secret|token|api_?key"
RULES = (
    Rule(
        "assign", "1", f"(?i:{KEYWORDS})[\"']?\\x20*[:=]",
        f"((?i:{KEYWORDS}))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8,
    ),
    Rule("access", "1", "AKIA[A-Z0-9]{12}", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "1", "[0-9a-f]{32}", "[0-9a-f]+", 0, 32),
)

LEDGER = "blob binary, rule string, spans array<struct<start: long, end: long>>"


def versions(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as given), ``blob`` (its text's digest, a null text is empty) and ``body``.

    Null identifiers and repeated rows stay rows of their own, with the findings of their text; a text of
    any length is one blob; an empty table gives an empty table, here and in the steps below. The row
    is a struct, so no other column can clash.
    """
    body = F.coalesce("doc.text", F.lit(""))
    return docs.select(F.struct("*").alias("doc")).select(
        "doc", F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("body")
    )


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Distinct blobs (``blob``, ``body``) with ``todo``, the rule versions they were not scanned under."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one entry per rule version
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    pairs = blobs.select("blob").distinct().join(seen, "blob", "left").withColumn("todo", todo)
    return blobs.dropDuplicates(["blob"]).join(pairs.filter(F.size("todo") > 0).drop("seen"), "blob")


def _pieces(rule: Rule) -> Column:
    """For one text: per match the length of the piece before it, its own length, and whether it counts."""
    body = F.col("body")
    found = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(body, rule.pattern, -1), F.length)
    row = lambda m, g: F.struct(F.length(m).alias("width"), (F.length(g) >= rule.least).alias("good"))
    return F.arrays_zip(
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), F.zip_with(found, judged, row).alias("hit")
    )


def scan(pending: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of blobs under the rules they have to do: ``blob``, ``rule``, ``start``, ``end`` (code points)."""
    parts = []
    for rule in rules:
        wanted = F.array_contains("todo", rule.name) & F.col("body").rlike(rule.hint)
        parts.append(F.when(wanted, F.struct(F.lit(rule.name).alias("rule"), _pieces(rule).alias("pieces"))))
    hits = pending.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    pieces = hits.select("blob", "p.rule", F.posexplode("p.pieces").alias("i", "m"))
    # a blob's matches of one rule, in order: at most as many rows as the text has characters
    upto = W.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.hit.width")).over(upto)
    placed = pieces.select("blob", "rule", (end - F.col("m.hit.width")).alias("start"), end.alias("end"), "m.hit.good")
    return placed.filter("good").drop("good")


def new_entries(pending: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for all pending pairs, those without findings included."""
    spans = scan(pending, rules).groupBy("blob", "rule").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    pairs = pending.select("blob", F.explode("todo").alias("rule"))
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    return pairs.join(spans, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", nothing).alias("spans"))


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every path with the findings of its blob under the current rule versions.

    ``paths`` has ``blob``; added are ``spans`` (array of start, order of kind, kind, end;
    sorted) and one count per kind, ``n_<kind>``.
    """
    known = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    place = F.element_at(known, F.col("rule"))
    current = ledger.filter(F.col("rule").isin([r.name for r in rules])).filter(F.size("spans") > 0)
    as_spans = F.transform(
        "spans",
        lambda s: F.struct(
            s.start.alias("start"), place.alias("nth"), F.element_at(kinds, place + 1).alias("kind"), s.end.alias("end")
        ),
    )
    per_blob = current.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(as_spans))).alias("spans"))
    out = paths.join(per_blob, "blob", "left").withColumn(
        "spans",
        F.coalesce("spans", F.array().cast("array<struct<start: long, nth: int, kind: string, end: long>>")),
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return out.withColumns({f"n_{r.kind}": count(r.kind) for r in rules})


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
