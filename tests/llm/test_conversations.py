import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from daftar.llm.conversations import advance, damaged, finish, repair, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def all_edits(rows):
    """Every list of edits with at most two insertions in a row: (cost, audit, lines) of the cheapest."""
    marks = faults(rows)
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    options = []
    for (_, role, text), mark in zip(rows, marks):
        some = [(3, "D", None)]
        if mark not in ("blank", "duplicate"):
            more = int(mark == "truncated")
            some += [(more, "K", (role, text)), (2 + more, "R", ("user", text)), (2 + more, "R", ("assistant", text))]
        options.append([(2 * len(g) + c, "I" * len(g) + a, [(r, "") for r in g] + ([line] if line else [])) for g in gaps for c, a, line in some])
    options.append([(2 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gaps])
    best = None
    for way in itertools.product(*options):
        lines = [line for _, _, some in way for line in some]
        if legal("".join(r[:1] or "?" for r, _ in lines)):
            offer = (sum(c for c, _, _ in way), "".join(a for _, a, _ in way), lines)
            best = offer if best is None or offer[:2] < best[:2] else best
    return best


def cheapest(rows):
    """The same by whole audits kept per state, for longer conversations."""
    marks, best = faults(rows), {"": (0, "", [])}
    step = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for (_, role, text), mark in zip(rows, marks):
        then = {}
        for state, (cost, audit, lines) in best.items():
            for _ in range(3):
                ways = [(3, "D", state, [])]
                if mark not in ("blank", "duplicate"):
                    more = int(mark == "truncated")
                    ways.append((2 + more, "R", step[state][0], [(step[state], text)]))
                    if role[:1] == step[state][0] or (role[:1] == "s" and state == ""):
                        ways.append((more, "K", role[:1], [(role, text)]))
                for c, a, to, line in ways:
                    offer = (cost + c, audit + a, lines + line)
                    then[to] = min(then.get(to, offer), offer, key=lambda x: x[:2])
                cost, audit, lines, state = cost + 2, audit + "I", lines + [(step[state], "")], step[state][0]
        best = then
    ends = []
    for state, (cost, audit, lines) in best.items():
        for _ in range(3):
            if state == "a" or (state == "" and not lines):
                ends.append((cost, audit, lines))
            cost, audit, lines, state = cost + 2, audit + "I", lines + [(step[state], "")], step[state][0]
    return min(ends, key=lambda x: x[:2])


def expected(rows, find=cheapest):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, marks = [t for t, _, _ in rows if t is not None], faults(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = find(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "USER", "a"]
    texts = ["Hi.", "Yes!", "And then", "", " \t", "Why? ", "ünder.", "x\n", "end. "]
    return [(rng.choice([None, *range(n + 3)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}.") for _ in range(n)]


def test_carried_state_against_all_edits():
    """Costs and audits of the program alone, and of the plain version, against every list of edits."""
    rng = random.Random(1)
    for nth in range(300):
        rows = [(0, r, t) for _, r, t in some_rows(rng, rng.randrange(4) if nth % 30 else 4)]
        want = all_edits(rows)
        assert cheapest(rows) == want
        costs, ranks, codes = (0, None, None, None), (0,) * 4, []
        for (_, role, _), mark in zip(rows, faults(rows)):
            costs, ranks, _, code = advance(costs, ranks, role[:1], mark in ("blank", "duplicate"), mark == "truncated")
            codes.append(code)
        cost, state, n = finish(costs, ranks)
        audit = "I" * n
        for code in reversed(codes):
            move = code >> 6 * state
            audit, state = "I" * (move >> 2 & 3) + " DKR"[move >> 4 & 3] + audit, move & 3
        assert (cost, audit) == want[:2]


def answer(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def digests(rows):
    found = {}
    for r in rows.orderBy("conv_id", "place").collect():
        assert r.place == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append((r.role, r.text))
    assert all(legal("".join(r[0] for r, _ in lines)) for lines in found.values())
    return {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest() for c, lines in found.items()}


def test_conversations_of_all_lengths(spark):
    """Random conversations, one of them giant, in segments of any length; the repaired rows have the digest given."""
    rng = random.Random(2)
    convs = {c: some_rows(rng, rng.choice([1, 2, 3, 5, 9, 30])) for c in range(150)} | {None: some_rows(rng, 5), 1000: some_rows(rng, 3000)}
    flat = [(c, *r) for c, rows in convs.items() for r in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, SCHEMA).repartition(7)
    want = {c: expected(rows) for c, rows in convs.items()}
    for segment in (1 << 18, 700, 3):
        repairs = repair(df, segment=segment)
        assert answer(repairs) == want
    repairs = repairs.cache()
    empty = hashlib.sha256(b"").hexdigest()
    made = digests(repaired_rows(df, repairs))
    assert {c: made.get(c, empty) for c in want} == {c: w[-1] for c, w in want.items()}
    repairs.unpersist()


def test_damage_and_odd_rows(spark):
    long_text = "word " * 400_000 + "end."
    rows = [(1, 0, "user", "Hi. You?"), (1, 1, "assistant", long_text), (1, 1, "assistant", long_text), (2, None, None, None), (3, 5, "system", "Be kind."),
            (3, -(1 << 63), "user", "a"), (3, (1 << 63) - 1, "user", "b"), (None, None, "user", ""), (4, 2, "user", "same"), (4, 2, "user", "same")]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Text {c}. {t}!") for c in range(10, 60) for t in range(6)]
    lost = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "All of it is lost."))
    df = spark.createDataFrame([(*r, "x", True) for r in rows], SCHEMA + ", audit string, gone boolean").repartition(3)
    convs: dict = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        convs.setdefault(c, []).extend(
            [(t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        )
    got = answer(repair(damaged(df), F.col("gone")))
    want = {c: expected(r) for c, r in convs.items()}
    want[3] = (min(want[3][0], (1 << 63) - 1), *want[3][1:])
    assert got == want and got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair(df.limit(0)).collect() == [] and repair(damaged(df.limit(0)), F.col("gone")).collect() == []
    gone = repair(df.filter("conv_id = 2"), F.lit(True)).collect()
    assert [tuple(r) for r in gone] == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
