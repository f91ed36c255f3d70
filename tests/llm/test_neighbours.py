import numpy as np

from leafmill.llm import neighbours
from leafmill.llm.neighbours import Pivots, found, graph, search, searched


def clustered(n=900, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 9, dim))
    return np.r_[[centres[i % len(centres)] + 0.25 * rng.normal(size=dim) for i in range(n)]] * rng.uniform(0.3, 4, size=(n, 1))


def frame(spark, x, extra=()):
    rows = [(i, f"c{i}", [float(v) for v in e], 1) for i, e in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, chunk_id string, embedding array<float>, sim int")


def brute(x, least, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def test_pairs_against_brute_force(spark):
    x = clustered()
    bad = [(5000, "n", None, 1), (5001, "z", [0.0] * 16, 1), (5002, "s", [1.0] * 9, 1), (5003, "x", [1.0] * 15 + [None], 1), (5004, "y", [1.0] * 15 + [float("nan")], 1), (None, "i", [1.0] * 16, 1), (3, "c3", [float(v) for v in x[3]], 1)]
    rows = [tuple(r) for r in found(frame(spark, x, bad), dim=16).collect()]
    want = brute(x, 0.9, 5)
    assert len(rows) == len(set(rows)) and len(want) > 1000
    assert len(want & set(rows)) >= 0.97 * len(want) and len(set(rows) - want) <= 0.03 * len(want)


def test_rounds_find_what_split_blocks_miss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(neighbours, "PER_PIVOT", 450)
    x = clustered()
    want = brute(x, 0.9, 5)
    recall = []
    for rounds in (0, 8):
        edges = graph(frame(spark, x), dim=16, least=0.2, rounds=rounds).where("rank <= 5 and sim >= 0.9").collect()
        recall.append(len({(min(r.v, r.u), max(r.v, r.u)) for r in edges} & want) / len(want))
    assert recall[0] < 0.8 and recall[1] > 0.9, recall


def test_all_neighbours_without_limit(spark):
    x = clustered(400, 8)
    got = {}
    for r in graph(frame(spark, x), dim=8).where("rank <= 5").collect():
        got.setdefault(r.v, set()).add(r.u)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:5])) for i in range(len(x)))
    assert hits >= 0.9 * 5 * len(x)


def test_copies_ties_and_nothing(spark):
    same = [[1.0, 2.0, 3.0, 4.0]] * 40
    rows = found(frame(spark, same), dim=4).collect()
    degree = {}
    for r in rows:
        for v in (r.vec_a, r.vec_b):
            degree[v] = degree.get(v, 0) + 1
    assert len(degree) == 40 and min(degree.values()) >= 5
    assert found(frame(spark, same[:1]), dim=4).count() == 0
    assert found(frame(spark, same).limit(0), dim=4).count() == 0
    assert found(frame(spark, [[0.0] * 4] * 3), dim=4).count() == 0


def test_greedy_search(spark):
    x = clustered(600, 8, 5)
    df = frame(spark, x)
    asked = frame(spark, x).where("vec_id % 20 = 0")
    got = {}
    for r in search(df, graph(df, dim=8), asked, dim=8).collect():
        got.setdefault(r.q, set()).add(r.u)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -2)
    assert sum(len(got[i] & set(np.argsort(-s[i])[:5])) for i in range(0, 600, 20)) >= 0.9 * 5 * 30
    assert search(df.limit(0), graph(df.limit(0), dim=8), asked, dim=8).count() == 0


def test_two_levels_of_pivots(spark, monkeypatch):
    x = clustered(2000, 16, 7)
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    flat = Pivots(unit[:600]).nearest(unit, 3)
    monkeypatch.setattr(neighbours, "TOP_PIVOTS", 20)
    two = Pivots(unit[:600])
    assert two.groups is not None and sum(len(rows) for rows, _ in two.groups) == 600
    near = two.nearest(unit, 3)
    assert (near >= 0).all() and (near[:, 0] == flat[:, 0]).mean() > 0.9
    monkeypatch.setattr(neighbours, "PER_PIVOT", 12)
    want = brute(x, 0.9, 5)
    rows = {tuple(r) for r in found(frame(spark, x), dim=16).collect()}
    assert len(want & rows) >= 0.97 * len(want)


def test_searched(spark):
    x = clustered(600, 8, 5)
    rows = searched(frame(spark, x, [(650, "n", None, 1), (700, "z", [0.0] * 8, 1)]), dim=8).collect()
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -2)
    assert {r.vec_id for r in rows} == set(range(0, 600, 50)) and all(r.vec_id != r.neighbour for r in rows)
    assert all(abs(r.score - s[r.vec_id, r.neighbour]) < 1e-3 for r in rows)
    assert sum(r.neighbour in set(np.argsort(-s[r.vec_id])[:5]) for r in rows) >= 0.9 * 60


def test_descent_leads_from_poor_blocks_to_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PER_PIVOT", 450)
    x = clustered()
    want = brute(x, 0.9, 5)
    rows = {tuple(r) for r in found(frame(spark, x), dim=16).collect()}
    assert len(want & rows) >= 0.95 * len(want)
