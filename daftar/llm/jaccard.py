"""Exact similarity join of shingle sets by partitioning the universe of shingles.

Sets are put into size bands. Within a band the universe (all 64-bit hashes) is cut into
segments. If two sets link, they differ in at most H elements, H following from the band;
so if thresholds v are given to segments with the sum of (v + 1) above H, in some segment
the two differ by at most v. Every set indexes its non-empty segments and probes H + 1 of
them at v = 0 (equal segments). Which ones is decided by cost: the holders of all keys are
counted exactly, and a set takes the segments that fewest others hold. Segments that nobody
else holds cost nothing, so a set without near copies probes nothing, whatever passages it
shares. A set whose elements crowd into too few segments takes v = 1 on some, which is
answered by one-deletion neighbourhoods on both sides. All candidates are verified exactly.

Only connectivity is asked for, so a probed key gives a star around its smallest holder.
Where a key's holders are still in different components after the stars were verified, these
documents form families (reachable through such keys). A family is cut into blocks; a pair of
blocks compares the documents that share a probed key and lie in different components, joins
their components at the first link, and gives out the links that span them. So no pair becomes a
row, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.llm.components import components
from daftar.llm.shared import drop_staged, small_batches, stage
from daftar.llm.shingles import digest, mixed, shingle_set

SHARE = 75  # sets link when 100 * intersection >= SHARE * union
KEYS_PER_PART = 1_500_000  # shingles; a part's keys, about twice as many, meet in one task
SINGLE = 315  # up to this size (the end of a band) every element is a segment of its own
LONG = 1000  # in larger sets a shared passage is a small part, and fewer segments do
_SEGMENT, _BAND, _SHORTER = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
# what a key is to its document: a segment it indexes and may probe, a segment of the band
# below that it may probe, an entry of the index alone, a probe that it has to make
OWN, BELOW, INDEX, MUST = range(4)


def bands(upto: int) -> list[int]:
    """Lower ends of the size bands, each at most half as large again as the one before."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


_LOWS = np.array(bands(1 << 40))


def most_different(size: int, band: int) -> int:
    """How many elements a set of this size can differ in from a set of the band that it links with."""
    largest = min(int(_LOWS[band + 1]) - 1, 100 * size // SHARE)
    return (size + largest) * (100 - SHARE) // (100 + SHARE)


def segments(band: int) -> int:
    """Segments of a band, 0 if each element is one: always more than the differences, so that dear ones can be left out."""
    high = int(_LOWS[band + 1]) - 1
    if high <= SINGLE:
        return 0
    return 2 * (high // 3 + 1) if high <= LONG else (high // 3 + 1) * 7 // 5


class Keys:
    """Keys of one set under one band's scheme."""

    def __init__(self, hashes: np.ndarray, band: int):
        self.band, self.differ, self.segments = band, most_different(len(hashes), band), segments(band)
        self.salt = np.uint64((self.band + 1) * int(_BAND) % (1 << 64))
        self.spread = mixed(hashes)
        if self.segments:
            segment = ((hashes >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
            self.starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(1 << 63)))
        else:
            segment, self.starts = hashes, np.arange(len(hashes))
        self.filled = segment[self.starts]
        self.sizes = np.diff(self.starts, append=len(hashes))
        self.sums = np.add.reduceat(self.spread, self.starts)
        self.full = self.key(self.sums, self.filled)
        self.missing = max(0, self.differ + 1 - len(self.full))
        self.loose = np.flatnonzero(self.sizes > 1)[: self.missing]  # segments that take v = 1
        self.blank = self.missing - len(self.loose)  # empty segments needed besides

    def key(self, sums: np.ndarray, segment: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(sums + (segment + np.uint64(1)) * _SEGMENT + self.salt)

    def without_one(self, which: np.ndarray) -> np.ndarray:
        """Keys of these segments less one element each."""
        out = [self.key(self.sums[i] - self.spread[self.starts[i] : self.starts[i] + self.sizes[i]], self.filled[i]) for i in which]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def empty(self, most: int | None = None) -> np.ndarray:
        left = np.setdiff1d(np.arange(self.segments, dtype=np.uint64), self.filled)[:most]
        return self.key(np.zeros(len(left), dtype=np.uint64), left)

    def more_probes(self) -> list[np.ndarray]:
        """Probes besides the segments' own keys, which all have to be made."""
        if not self.missing:
            return []
        return [self.without_one(self.loose), mixed(self.full[self.loose] ^ _SHORTER), self.empty(self.blank)]

    def more_index(self, deletions: bool, blanks: bool) -> list[np.ndarray]:
        """Index keys besides the segments' own."""
        parts = []
        if deletions:  # segments of one element cannot be one more than a non-empty one
            parts.append(mixed(self.without_one(np.flatnonzero(self.sizes > 1)) ^ _SHORTER))
        if blanks:
            parts.append(self.empty())
        return parts


def schemes(hashes: np.ndarray) -> list[Keys]:
    """The set's own band, and the one below if smaller partners can be there."""
    band = int(np.searchsorted(_LOWS, len(hashes), "right")) - 1
    smallest = -(-SHARE * len(hashes) // 100)
    return [Keys(hashes, b) for b in (band, band - 1) if b == band or (b >= 0 and smallest < _LOWS[band])]


def keys_of(hashes: np.ndarray, loose: set[int], blank: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a set and what each is to it (OWN, BELOW, INDEX, MUST)."""
    own, *below = schemes(hashes)
    parts = [(OWN, [own.full]), (BELOW, [k.full for k in below])]
    parts += [(INDEX, own.more_index(own.band in loose, own.band in blank)), (MUST, own.more_probes() + [x for k in below for x in k.more_probes()])]
    keys = np.concatenate([x for _, some in parts for x in some])
    use = np.repeat(np.array([u for u, _ in parts], dtype=np.uint64), [sum(map(len, some)) for _, some in parts])
    return keys, use


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


SETS = "doc_id long, n long, digest binary, probes array<int>, filled array<int>, loose array<int>, blank array<int>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set sizes and digests; by scheme (own, below) how many probes are more than the set's
    segments (negative: fewer) and the bands for which deletions and empty segments are needed."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for doc_id, text in _texts(batch):
            hashes = shingle_set(text)
            keys = schemes(hashes) if len(hashes) else []
            rows.append((
                doc_id, len(hashes), digest(hashes) if len(hashes) else None, [k.differ + 1 - len(k.full) for k in keys], [len(k.full) for k in keys],
                [k.band for k in keys if k.missing], [k.band for k in keys if k.blank],
            ))
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n", "digest", "probes", "filled", "loose", "blank"]
        )


PACKED = "part long, docs binary, counts binary, keys binary"


def _pack(parts: int, loose: set[int], blank: set[int]):
    """Keys by part: per batch and part one row with the documents, their numbers of keys, and 5 bytes per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies within a task give keys once; 16 bytes per document of the task
        for batch in batches:
            ids, keys, uses = [], [], []
            for doc_id, text in _texts(batch):
                hashes = shingle_set(text) if doc_id is not None else np.zeros(0, dtype=np.uint64)
                mark = digest(hashes)
                if not len(hashes) or mark in seen:
                    continue
                seen.add(mark)
                k, u = keys_of(hashes, loose, blank)
                ids.append(doc_id), keys.append(k), uses.append(u)
            if not ids:
                continue
            key, use = np.concatenate(keys), np.concatenate(uses)
            owner = np.repeat(np.arange(len(ids)), list(map(len, keys)))
            part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            packed = ((key & np.uint64((1 << 38) - 1)) << np.uint64(2) | use)[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            owner, ids = owner[order], np.array(ids, dtype=np.int64)
            rows: list[list] = [[], [], [], []]
            for p in np.flatnonzero(np.diff(cuts)):
                mine = owner[cuts[p] : cuts[p + 1]]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                many = np.diff(first, append=len(mine)).astype(np.int32)
                for column, value in zip(rows, (int(p), ids[mine[first]].tobytes(), many.tobytes(), packed[cuts[p] : cuts[p + 1]].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["part", "docs", "counts", "keys"])

    return run


FOUND = "doc_id long, use int, held long, n_keys long, before long, lead long, indexed boolean"


def _meet(group: pa.Table) -> pa.Table:
    """Of one part: keys with an indexing and a further document, those with the same holders taken together.

    A row per holder: ``held`` names the set of holders, ``n_keys`` says how many keys they
    share, ``before`` how many candidates the holder gets by probing, ``lead`` the smallest.
    Of two documents of one band the larger identifier probes.
    """
    ids, keys = [], []
    for docs, counts, packed in zip(*[group.column(c) for c in ("docs", "counts", "keys")], strict=True):
        ids.append(np.repeat(np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32)))
        wide = np.zeros((len(ids[-1]), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 5)
        keys.append(wide.view("<u8").ravel())
    who, key = np.concatenate(ids), np.concatenate(keys)
    del ids, keys
    use, key = (key & np.uint64(3)).astype(np.int8), key >> np.uint64(2)
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    size = np.diff(first, append=len(key))
    order = order[np.repeat(size > 1, size)]
    key, who, use = key[order], who[order], use[order]
    # within a key: indexing documents first, by identifier
    index = (use == OWN) | (use == INDEX)
    order = np.lexsort((use, who, ~index, key))
    key, who, use, index = key[order], who[order], use[order], index[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(first, append=len(key))
    indexing = np.add.reduceat(index.astype(np.int64), first) if len(first) else size
    place = np.arange(len(key)) - np.repeat(first, size)
    # candidates by probing: all indexing documents, or those before it in its own band
    before = np.where(use == OWN, place, np.where(use == INDEX, 0, np.repeat(indexing, size)))
    met = np.repeat(np.add.reduceat(before, first) > 0, size) if len(first) else np.zeros(0, dtype=bool)
    key, who, use, index, before = key[met], who[met], use[met], index[met], before[met]
    if not len(key):
        return pa.Table.from_batches([], schema=_FOUND)
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(first, append=len(key))
    names = np.add.reduceat(mixed(who.astype(np.uint64) * np.uint64(4) + use.astype(np.uint64)), first)
    names, chosen, many = np.unique(names, return_index=True, return_counts=True)
    rows = np.repeat(first[chosen], size[chosen]) + np.arange(size[chosen].sum()) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
    n = size[chosen]
    return pa.table([
        pa.array(who[rows]), pa.array(use[rows].astype(np.int32)), pa.array(np.repeat(names, n).astype(np.int64)), pa.array(np.repeat(many, n).astype(np.int64)),
        pa.array(before[rows]), pa.array(np.repeat(who[first[chosen]], n)), pa.array(index[rows]),
    ], schema=_FOUND)


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("use", pa.int32()), ("held", pa.int64()), ("n_keys", pa.int64()), ("before", pa.int64()), ("lead", pa.int64()), ("indexed", pa.bool_()),
])


def _with_alone(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``probes`` and ``alone``: how many of the document's segments nobody it could meet holds."""
    known = sets.groupBy("doc_id").agg(
        F.first("probes").alias("probes"), F.first("filled").alias("filled"), (F.min("digest") != F.max("digest")).alias("several")
    )
    shared = found.groupBy("doc_id", "use").agg(F.sum("n_keys").alias("shared"))
    of = lambda c: F.coalesce(F.try_element_at(c, F.col("use") + 1), F.lit(0))
    # an identifier with several texts probes all, and nothing is known to be alone
    told = shared.join(known, "doc_id").select(
        "doc_id", "use",
        F.when(F.col("several"), F.lit(1)).otherwise(of("probes")).alias("probes"),
        F.when(F.col("several") | (F.col("use") > BELOW), F.lit(0)).otherwise(F.greatest(of("filled") - F.col("shared"), F.lit(0))).alias("alone"),
    )
    return found.join(told, ["doc_id", "use"])


def _probed(found: DataFrame) -> DataFrame:
    """The cost-based allocation: rows of ``found`` that their documents probe.

    Segments nobody else holds come first, then those with the fewest candidates; a row is
    left out if it and all dearer ones fit into what a document has more than it must probe.
    The rows of a document are at most its keys.
    """
    dearer = W.partitionBy("doc_id", "use").orderBy(F.desc("before"), F.desc("held")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = found.filter("before > 0").withColumn("dear", F.sum("n_keys").over(dearer))
    return rows.filter((F.col("use") == MUST) | (F.col("dear") > -F.col("probes"))).drop("dear")


def _possible(df: DataFrame) -> DataFrame:
    """Distinct pairs a < b of representatives that can link, from rows with ra, na, la and rb, nb, lb.

    l counts segments that the other side cannot hold. Each is a difference; where segments
    are single elements those of both sides add up.
    """
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    apart = F.when(small <= SINGLE, F.col("la") + F.col("lb")).otherwise(F.greatest("la", "lb"))
    ok = (F.col("ra") != F.col("rb")) & (100 * small >= SHARE * large) & (apart * (100 + SHARE) <= (small + large) * (100 - SHARE))
    return df.filter(ok).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


PAIRS_PER_BLOCK = 2000


def _linked(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Of one block of pairs those that link; every text of the block becomes a set once."""
    sets: dict[int, list[np.ndarray]] = {}
    for doc_id, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
        sets.setdefault(doc_id, []).append(shingle_set(text))

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= SHARE * (len(x) + len(y) - both) and both > 0

    keep = [
        any(link(x, y) for x in sets.get(a, ()) for y in sets.get(b, ()))
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)
    ]
    return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives that link, checked on whole texts.

    Pairs are cut into blocks by both identifiers, so a text goes once to each block that
    needs it, however many pairs it is in. A block with more pairs (those of one star meet in a
    row of blocks) is cut further by pair.
    """
    side = int((pairs.count() / PAIRS_PER_BLOCK) ** 0.5) + 1
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    cut = pairs.select("a", "b", part("a").alias("i"), part("b").alias("j"))
    crowds = cut.groupBy("i", "j").agg(F.ceil(F.count("*") / (2 * PAIRS_PER_BLOCK)).cast("int").alias("crowd"))
    # one column, so that rows are dealt out by the whole of it and not by i and j alone
    block = F.concat_ws("-", "i", "j", F.pmod(F.xxhash64("a", "b"), F.col("crowd")))
    cut = cut.join(crowds, ["i", "j"]).select("a", "b", block.alias("block"))
    needs = cut.select(F.col("block").alias("of"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = needs.join(texts, "doc_id").select("of", "doc_id", "text")
    links = cut.groupBy("block").cogroup(full.groupBy("of")).applyInArrow(_linked, "a long, b long")
    return stage(links, "links").distinct()


ELEMENTS = 1_000_000  # of the sets on either side of a pair of blocks
PACKED_SET = "doc_id long, hashes binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingle_set(text).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], names=["doc_id", "hashes"])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class _Holders:
    """Rows of a block by the keys they hold."""

    def __init__(self, rows: pa.ChunkedArray):
        rows = rows.combine_chunks()
        n = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, row = rows.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
        order = np.argsort(key, kind="stable")
        self.key, self.row = key[order], row[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.key, keys, "left")
        return self.row[_ranges(first, np.searchsorted(self.key, keys, "right") - first)]


def _span(group: pa.Table) -> pa.Table:
    """Of one pair of blocks: links (a, b) that join components of left documents with others.

    A left document and another are compared if one probes a key that the other indexes and
    no link has joined their components yet. Sets are kept once, as places in a common
    vocabulary; the intersections of a left set with all it has to meet are counted together.
    """
    ids, component, left, in_main = (group.column(c).to_numpy() for c in ("r", "component", "left", "in_main"))
    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    _, flat = np.unique(np.concatenate(raw), return_inverse=True)
    flat, start = flat.astype(np.int32), np.cumsum(size) - size
    del raw
    asks, asked = (group.column(c) for c in ("asks", "asked"))
    right = np.flatnonzero(~left)
    asking, indexing = _Holders(asks.filter(pa.array(~left))), _Holders(asked.filter(pa.array(~left)))
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    names, own = np.unique(component, return_inverse=True)
    parent = np.arange(len(names))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    keys = lambda c, a: np.array(c[a].as_py() or [], dtype=np.int64)
    for a in np.flatnonzero(left).tolist():
        others = right[np.unique(np.concatenate([indexing.of(keys(asks, a)), asking.of(keys(asked, a))]))]
        least, most = np.minimum(size[others], size[a]), np.maximum(size[others], size[a])
        # two documents outside the main component meet twice, from either side
        once = in_main[others] | (ids[others] > ids[a])
        others = others[(component[others] != component[a]) & (100 * least >= SHARE * most) & once]
        if not len(others):
            continue
        mine = flat[start[a] : start[a] + size[a]]
        mark[mine] = True
        both = np.add.reduceat(mark[flat[_ranges(start[others], size[others])]], np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[mine] = False
        for b in others[100 * both >= SHARE * (size[a] + size[others] - both)].tolist():
            x, y = root(int(own[a])), root(int(own[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _across(asking: DataFrame, asked: DataFrame, of: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that span components, from rows (doc_id, held) of documents that probe and that index a key."""

    def named(df: DataFrame, probes: bool) -> DataFrame:
        rows = df.join(of, "doc_id").select(F.col("rep").alias("r"), "held", F.lit(probes).alias("probes")).distinct()
        return rows.join(joined.withColumnRenamed("node", "r"), "r", "left").withColumn("component", F.coalesce("component", "r"))

    rows = stage(named(asking, True).union(named(asked, False)), "key-components")
    apart = rows.groupBy("held").agg(F.min("r").alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("probes").alias("x"), F.max("probes").alias("y"))
    apart = apart.filter("lo < hi and x != y").select("held", "hub")
    rows, before = stage(rows.join(apart, "held"), "keys-apart"), rows
    drop_staged(before)
    members = rows.groupBy("r", "component").agg(*[F.collect_list(F.when(F.col("probes") == p, F.col("held"))).alias(c) for p, c in ((True, "asks"), (False, "asked"))])
    reach = components(rows.select(F.col("hub").alias("a"), F.col("r").alias("b")).distinct())
    mine = texts.join(members.select(F.col("r").alias("doc_id")), "doc_id", "left_semi")
    # a representative with several texts holds all; each text is compared by itself
    sets = mine.mapInArrow(_sets, PACKED_SET).select(F.col("doc_id").alias("r"), "hashes").distinct()
    docs = members.join(reach.select(F.col("node").alias("r"), F.col("component").alias("family")), "r").join(sets, "r")
    families = docs = stage(docs.withColumn("n", F.length("hashes") / 8), "families")
    drop_staged(rows)
    # all but a family's largest component meet all of the family
    parts = docs.groupBy("family", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    plan = parts.groupBy("family").agg(F.max_by("component", F.struct("docs", "component")).alias("main"), F.sum("n").alias("n"), F.max_by("n", F.struct("docs", "component")).alias("of_main"))
    blocks = lambda n: F.ceil(n / ELEMENTS).cast("int")
    plan = plan.select("family", "main", blocks(F.col("n")).alias("rights"), blocks(F.col("n") - F.col("of_main")).alias("lefts")).filter("lefts > 0")
    docs = docs.join(plan, "family")
    own = lambda n: F.pmod(F.xxhash64("r", "hashes"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # one column, so that rows are dealt out by the whole of it and not by family alone
    block = F.concat_ws("-", "family", "i", "j").alias("block")
    columns = [block, "r", "component", "asks", "asked", "hashes", "left", (F.col("component") == F.col("main")).alias("in_main")]
    left = docs.filter("component != main").withColumn("i", own("lefts")).withColumn("j", each("rights")).withColumn("left", F.lit(True))
    right = docs.withColumn("j", own("rights")).withColumn("i", each("lefts")).withColumn("left", F.lit(False))
    links = left.select(*columns).union(right.select(*columns)).groupBy("block").applyInArrow(_span, "a long, b long")
    links = stage(links, "spanning-links")
    drop_staged(families)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``, ``component_id``.

    Null, empty and blank texts have an empty set, link with nothing and are their own
    component. Other rows that share a doc_id count as one document that holds all their texts. A row with a null doc_id links
    with nothing and has a null component. Equal texts link however often they occur; ties
    in size or cost change the work only. An empty table gives an empty table. Columns besides
    doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(texts.mapInArrow(_describe, SETS), "shingle-sets")
    # bounded: at most one entry per size band, and one number
    need = sets.agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("loose", "blank")], F.sum("n").alias("n")).first()
    parts = -(-(need.n or 0) // KEYS_PER_PART) or 1

    named = sets.filter("n > 0 and doc_id is not null")
    heads = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    of = stage(named.join(heads, "digest").select("doc_id", "rep", "n").distinct(), "representatives")
    packed = texts.mapInArrow(_pack(parts, set(need.loose), set(need.blank)), PACKED)
    found = packed.groupBy("part").applyInArrow(_meet, FOUND)
    # the same holders may share keys in several parts
    found = found.groupBy("doc_id", "use", "held").agg(
        F.sum("n_keys").alias("n_keys"), F.max("before").alias("before"), F.min("lead").alias("lead"), F.max("indexed").alias("indexed")
    )
    found = stage(found, "key-holders")
    told = stage(_with_alone(found, sets), "key-holders-told")
    drop_staged(found)
    found, probed = told, stage(_probed(told), "probes")

    def by_rep(df: DataFrame, side: str, *more: str) -> DataFrame:
        """Rows with ``doc_id`` and ``alone`` as their representatives ``r``, sizes ``n``, and the least alone ``l``."""
        named = df.join(of, "doc_id").select(F.col("rep").alias(f"r{side}"), F.col("n").alias(f"n{side}"), F.col("alone").alias(f"l{side}"), *more)
        return named.groupBy(f"r{side}", f"n{side}", *more).agg(F.min(f"l{side}").alias(f"l{side}"))

    # a star around the smallest holder of the keys a document probes
    alone = found.filter(F.col("use") == OWN).select(F.col("doc_id").alias("lead"), "alone").distinct()
    leaders = probed.select("lead").distinct().join(alone, "lead", "left")
    leaders = leaders.select("lead", F.col("lead").alias("doc_id"), F.coalesce("alone", F.lit(0)).alias("alone"))
    leads = by_rep(probed.select("doc_id", "alone", "lead"), "a", "lead").join(by_rep(leaders, "b", "lead"), "lead")
    stars = stage(_possible(leads), "stars")

    # further candidates of probes, which the stars may not bring together with their document
    several = probed.filter("before > 1").select("doc_id", "held")
    asked = found.filter("indexed").join(several.select("held").distinct(), "held", "left_semi").select("doc_id", "held")

    # texts are searched once for those that any comparison needs
    compared = stars.select(F.explode(F.array("a", "b")).alias("rep"))
    compared = compared.union(several.select("doc_id").union(asked.select("doc_id")).distinct().join(of, "doc_id").select("rep"))
    needed = stage(texts.join(compared.distinct().withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").distinct(), "texts-compared")

    links = _verify(stars, needed)
    drop_staged(stars)
    again = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi")
    repeated = of.join(again, "doc_id").select("a", F.col("rep").alias("b")).filter("a != b")
    links = links.union(repeated)
    joined = stage(components(links), "components")

    across = _across(several, asked, of, joined, needed)
    for done in (found, probed, needed):
        drop_staged(done)
    if not across.isEmpty():
        drop_staged(joined)
        joined = stage(components(links.union(across)), "components")
    drop_staged(of)

    out = (
        sets.join(heads, "digest", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, …) whose doc_id is the smallest of its component, all columns as they are.

    Rows that share a doc_id count as one document, of which the least row by its columns'
    order stays. Texts without words and rows with a null doc_id all stay.
    """
    marked = near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(
        F.max("n_shingles").alias("n"), F.min("component_id").alias("component"), F.count("*").alias("rows")
    )
    heads = marked.filter("component = doc_id").select(F.col("doc_id").alias("id"), "n", "rows")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id")).join(heads, "id")
    alone = (F.col("rows") == 1) | (F.col("n") == 0)
    least = rows.filter(~alone).groupBy("id").agg(F.min("row").alias("row"))
    nameless = docs.filter(F.col("doc_id").isNull()).select(F.struct("*").alias("row"))
    return rows.filter(alone).select("row").union(least.select("row")).union(nameless).select("row.*")
