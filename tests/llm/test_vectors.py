import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from daftar.llm import multi_index, topk
from daftar.llm.topk import best, choose_pivots, scaled

SCHEMA = "vec_id long, embedding array<double>, score int"
NAN = float("nan")
ODD = [(1000, None, 1), (1001, [], 1), (1002, [None, 1.0], 1), (1003, [NAN, 1.0], 1), (1004, [float("inf"), 1.0], 1), (1005, [0.0, 0.0], 1), (None, [1.0, 0.0], 1)]


def links(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                out.append((i, j))
    return out


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(200)]
    rows += [(300 + i, rows[7][1], 0) for i in range(30)] + [(400, (3 * np.array(rows[9][1])).tolist(), 0), (401, [1.0, 0.01], 0), (402, [1.0, 0.0], 0)] + ODD
    want = links(rows)
    component = brute.components([r[0] for r in rows], want)
    n = {r[0]: 0 for r in rows}
    for a, b in want:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(r.n_links for r in got.values() if r.n_links) / 2
    assert 0.98 * len(want) <= found <= len(want)
    same = sum(got[i].component_id == component[i] for i in got if i is not None)
    assert same >= 0.98 * (len(got) - 1) and got[None].component_id is None and got[1005].kept and got[307].component_id == component[7]
    assert multi_index.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_count_once_in_any_row_order():
    # two vectors at home in cells 5 and 9, both visiting both: each pair meets twice
    raw = [np.array([1.0, 0.01 * i]).tobytes() for i in range(4)]
    home, times = [5, 9, 5, 9], [1, 2, 3, 1]
    rows = [(i, times[i], raw[i], home[i], [home[i], 14 - home[i]], False) for i in range(4)]
    names = ["id", "times", "v", "home", "visited", "visitor"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
    rng = np.random.default_rng(4)
    for turn in range(20):
        total = dict.fromkeys(range(4), 0)
        for cell in (5, 9):
            group = [r for r in rows if r[3] == cell] + [(*r[:4], [], True) for r in rows]
            order = rng.permutation(len(group)) if turn else range(len(group))[::-1]
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*[group[i] for i in order], strict=True), types, strict=True)], names=names)
            for r in multi_index._compare(0.95)(table).to_pylist():
                total[r["id"]] += r["links"]
        assert total == {i: sum(times) - times[i] for i in range(4)}, turn


def test_recall_on_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = pq.read_table(path)
    x = np.array(t.column("embedding").combine_chunks().flatten()).reshape(t.num_rows, -1).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    n = dict(zip(t.column("vec_id").to_pylist(), close.sum(axis=1), strict=True))
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(spark.read.parquet(path)).collect()}
    assert all(got[i] <= n[i] for i in n) and sum(got.values()) >= 0.95 * sum(n.values())


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(5)
    x = scaled(np.concatenate([rng.normal(size=(1500, 8)) * 0.1, rng.normal(size=(1500, 8))]))
    ids, table = np.arange(3000), topk._table(x, choose_pivots(x[:500]))
    evaluated = 0
    for q in range(0, 3000, 50):
        got_ids, got, n = best(x[q], q, table[q], ids, x, table, 5, -np.inf)
        scores = (x @ x[q]).astype(np.int64)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert got_ids.tolist() == order and got.tolist() == scores[order].tolist()
        evaluated += n
    assert evaluated < 0.9 * 60 * 2999


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.5], 0), (2, [1.0, -0.5], 0), (50, [-1.0, 2.0], 0), (3, [1.0, 2.0, 3.0], 0), (2, [1.0, -0.5], 0), *ODD]
    out = topk.top_k(spark.createDataFrame(rows, SCHEMA), topk.F.col("vec_id") % 50 == 0, 3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect())
    assert got[:3] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536)]
    assert [g[2:] for g in got if g[0] == 50] == [(1, 0), (1005, 0), (0, -65536)] and {g[0] for g in got} == {0, 50}
    assert topk.top_k(spark.createDataFrame([], SCHEMA), topk.F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_of_large_components(spark):
    """Beyond what doubles and longs hold: exact where a long can say it, else at its ends."""
    import math

    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    scales = [1.0, 1e5, 8e6, 1e12, 1e200, 1e308]
    rows = [(i, (rng.uniform(-1, 1, 3) * scales[i % 6]).tolist(), 0) for i in range(90)] + [(90, [1e308] * 3, 0), (91, [-1e308] * 3, 0), (92, [0.0] * 3, 0)]
    whole = {i: [int(x) * 256 if abs(x) > 1e300 else math.floor(x * 256) for x in v] for i, v, _ in rows}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {}
    for q in range(0, 93, 10):
        scores = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)
        want[q] = [(i, -s) for s, i in scores[:5]]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_copies_of_query_blocks_are_not_broadcast(spark, monkeypatch):
    """They are reckoned as one copy, so a broadcast would gather them all in the driver; several shares and groups give the same."""
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, size=(300, 6)) / 256
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    monkeypatch.setattr(topk, "BLOCK", 16), monkeypatch.setattr(topk, "QUERY_BLOCK", 4), monkeypatch.setattr(topk, "GROUP", 3, raising=False)
    out = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), topk.F.col("vec_id") % 10 == 0, 4)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    scores = (256 * x) @ (256 * x).T
    want = {(q, k + 1): (v, int(scores[q, v])) for q in range(0, 300, 10) for k, v in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-scores[q, i], i))[:4])}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in out.collect()} == want


def test_grid_bounds_copies_and_what_a_task_holds():
    for candidates, queries in ((1, 1), (5, 1), (4000, 300), (4000, 16000), (0, 0)):
        shares, groups = topk._grid(candidates, queries, 12)
        assert 1 <= shares <= max(1, candidates) and queries <= groups * topk.GROUP
        assert queries * topk.QUERY_BLOCK * shares <= max(candidates * topk.BLOCK, 24 * queries * topk.QUERY_BLOCK, topk.QUERY_BLOCK)
