import random
import re

import pytest

from daftar.llm import licenses
from daftar.llm.licenses import BASE, TEMPLATES, Automaton, OneOf, Optional, Replaceable, as_pattern, mandatory, parse


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def wording(rng, parts) -> list[str]:
    """Some wording that the parts accept."""
    out = []
    for p in parts:
        if isinstance(p, bytes):
            out.append(p.decode())
        elif isinstance(p, Optional):
            out += wording(rng, p.inner) if rng.random() < 0.5 else []
        elif isinstance(p, OneOf):
            out += [w.decode() for w in rng.choice(p.phrases)]
        elif isinstance(p, Replaceable):
            out += [rng.choice(["any", "mit", "license", "wörter", "7"]) for _ in range(rng.randint(p.least, p.most))]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automaton_against_patterns(seed):
    rng = random.Random(seed)
    automaton = Automaton(TEMPLATES)
    patterns = [re.compile(" " + as_pattern(p)) for p in automaton.parts]
    hits = 0
    for _ in range(400):
        text = []
        for _ in range(rng.randrange(4)):
            some = wording(rng, rng.choice(automaton.parts))
            if rng.random() < 0.5:  # one word changed, missing or added
                at = rng.randrange(len(some))
                some[at : at + rng.randrange(2)] = [rng.choice(["x", some[at], "the"])] * rng.randrange(2)
            text += some + [rng.choice(["is", "mit", "under", "zzz"])] * rng.randrange(3)
        joined = " ".join(text)
        n, ends = automaton.ends(joined.upper() if rng.random() < 0.2 else joined.replace(" ", rng.choice([" ", "\n", ", ", " (\x00"])))
        assert n == len(text)
        assert {t for t, _ in ends} == {i for i, p in enumerate(patterns) if p.search(" " + joined + " ")}
        for t, at in ends:  # the wording ends where it is said to end
            assert re.search(" " + as_pattern(automaton.parts[t]) + "$", " " + " ".join(text[: at + 1]) + " ")
        hits += len(ends)
    assert hits > 200


def test_every_template_accepts_its_own_wording_and_no_changed_mandatory_word():
    automaton, rng = Automaton(TEMPLATES), random.Random(5)
    for nth, parts in enumerate(automaton.parts):
        some = wording(rng, parts)
        assert nth in {t for t, _ in automaton.ends(" ".join(some))[1]}
        plain = [p.decode() for p in parts if isinstance(p, bytes)]
        for word in set(plain):
            if word not in ("1", "2", "3"):  # optional numbers of a list
                assert nth not in {t for t, _ in automaton.ends(" ".join("qq" if w == word else w for w in some))[1]}


def test_states_are_rebuilt_when_there_are_too_many(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(w for _ in range(5) for w in wording(rng, rng.choice(Automaton(TEMPLATES).parts))) for _ in range(20)]
    want = [Automaton(TEMPLATES).ends(t) for t in texts]
    monkeypatch.setattr(licenses, "STATES", 7)
    few = Automaton(TEMPLATES)
    assert [few.ends(t) for t in texts] == want and len(few._sets) <= 9


def test_markup():
    parts = parse('A <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name="x";original="y";words="0-2">> <<var;match="d e|f">> G')
    assert parts == (b"a", Optional((b"b", Optional((b"c",)))), Replaceable(0, 2), OneOf(((b"d", b"e"), (b"f",))), b"g")
    assert mandatory(parts) == 3
    for wrong in ("a <<endOptional>>", "<<beginOptional>> a", 'a <<var;other="b">>'):
        with pytest.raises(ValueError):
            parse(wrong)
    with pytest.raises(ValueError):
        Automaton([("none", "<<beginOptional>> a <<endOptional>>")])


def plain_find(text):
    words = plain_words(text)
    places = sorted((i, label) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    joined = " " + " ".join(words) + " "
    own = [(label, mandatory(parse(t))) for label, t in TEMPLATES if re.search(" " + as_pattern(parse(t)), joined)]
    found = [(label, len(p.split())) for label, p in BASE if any(x == label for _, x in places)]
    m = max((n for _, n in own + found), default=0)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in found})),
            ",".join(sorted({x for x, _ in own + found})), m / (m + 4))


def test_find_on_odd_rows(spark):
    mit = dict(TEMPLATES)["mit-text"]
    mit = re.sub("<<beginOptional>>.*?<<endOptional>>", "", mit, flags=re.S)
    far = "word " * 300_000 + "General-Public\tLicense " + "x" * 100_000 + " " + mit.upper()
    texts = [None, "", " .,;", "MIT License", "mit mit license license mit license", "MIT License", "É MIT-LICENSE é", far, far, mit,
             "released under the MIT Licence.", "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0."]
    rows = [(i if i else None, t, "a", "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, base string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.find(df).collect()}
    assert got == {i if i else None: plain_find(t) for i, t in enumerate(texts)}
    assert got[7][:4] == (300_000 + 3 + 1 + len(plain_words(mit)), 1, 300_000, 300_000) and got[7][5] == "gpl,mit-text"
    assert licenses.find(df.limit(0)).collect() == []
    kept = licenses.scan(df, "doc_id", "labels", templates=[("mine", 'foo <<var;words="0-1">> bar')])
    assert kept.select("kept.labels").distinct().collect()[0].labels == "a"
