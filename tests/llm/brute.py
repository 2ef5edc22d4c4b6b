"""Plain versions of operators, for small inputs."""

from __future__ import annotations

import re


def shingles(text: str | None) -> set[tuple[str, ...]]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_duplicates(docs: dict) -> dict:
    """doc_id to (size, component) from all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(sets)
    linked = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    component = components(ids, linked)
    return {d: (len(sets[d]), component[d]) for d in ids}
