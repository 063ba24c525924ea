import numpy as np

from lodestrand.llm import neighbours as N
from tests.conftest import rows


def frames(spark, vecs, index=()):
    ev = spark.createDataFrame([(e, s, None if v is None else [float(x) for x in v], 0) for e, s, v in vecs], "event_id string, chunk_seq int, embedding array<float>, key int")
    vi = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in index], "vec_rowid long, embedding array<float>")
    return ev, vi


def clustered(n, seed=0, width=64):
    r = np.random.default_rng(seed)
    c = r.standard_normal((12, width))
    return (c[r.integers(0, 12, n)] + 0.9 * r.standard_normal((n, width))).astype(np.float32)


def brute(m, k=10):
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_search_block_recall():
    m = clustered(1500)
    ids = np.arange(len(m))
    q, d, _ = N.search_block(m[:300], m, ids[:300], ids, 10, N.rotation(64))
    _, top = brute(m)
    hits = sum(int(b in set(top[a])) for a, b in zip(q, d))
    assert hits / 3000 > 0.97 and not (q == d).any()


def test_bounds_discard():
    m = clustered(3000, 1)
    counts = {}
    ids = np.arange(len(m))
    N.search_block(m[:200], m, ids[:200], ids, 10, N.rotation(64), counts=counts)
    assert counts["reranked"] < 0.3 * counts["seen"]


def test_join_recall(spark):
    m = clustered(2500, 2)
    vecs = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(m)], "id long, vec binary")
    near = N.knn_join(vecs, lists=16, probes=5).cache()
    assert near.count() == len(m)
    assert N.recall_at_k(vecs, near, every=4) >= 0.9
    _, top = brute(m)
    got = {r.id: [x.id for x in r.near] for r in near.collect()}
    assert all(i not in g and len(g) == 10 and len(set(g)) == 10 for i, g in got.items())
    assert sum(len(set(g) & set(top[i])) for i, g in got.items()) / (10 * len(m)) >= 0.9


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    m = clustered(900, 3)
    vecs = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(m)], "id long, vec binary")
    got = {r.id: {x.id for x in r.near} for r in N.knn_join(vecs, lists=4, probes=4).collect()}
    _, top = brute(m)
    assert sum(len(got[i] & set(top[i])) for i in got) / (10 * len(m)) > 0.97


def test_found(spark):
    m = clustered(60, 4)
    vecs = [(f"e{i}", 0, v) for i, v in enumerate(m)]
    vecs += [("e0", 0, m[0]), ("twin", 1, m[0] * 2), ("near", 2, m[5] + 0.05), ("n", 0, None), ("z", 0, np.zeros(64)), ("w", 0, np.ones(32)), ("nan", 0, np.full(64, np.nan)), (None, 3, m[1])]
    ev, vi = frames(spark, vecs, [(1, m[7]), (2, None)])
    got = rows(N.neighbours_found(ev, vi))
    assert ("e0#0", "twin#1") in got and ("e5#0", "near#2") in got and ("e7#0", "vec#1") in got
    keys = [f"e{i}#0" for i in range(60)] + ["twin#1", "near#2", "vec#1"]
    s, top = brute(np.vstack([m, m[0] * 2, m[5] + 0.05, m[7]]))
    want = {tuple(sorted((keys[i], keys[j]))) for i in range(len(keys)) for j in top[i] if s[i, j] >= 0.9}
    assert set(got) == want and len(got) == len(set(got))


def test_hot_copies(spark):
    m = clustered(30, 5)
    ev, vi = frames(spark, [(f"c{i:04d}", 0, m[0]) for i in range(300)] + [(f"e{i}", 0, v) for i, v in enumerate(m[1:])])
    got = rows(N.neighbours_found(ev, vi))
    linked = {k for p in got for k in p}
    assert {f"c{i:04d}#0" for i in range(300)} <= linked and len(got) <= 300 * 10
    per = {}
    for a, b in got:
        per.setdefault(b, set()).add(a)
    assert all(len(per[f"c{i:04d}#0"]) == 10 for i in range(50, 300))


def test_lists_of_every_key(spark):
    m = clustered(40, 6)
    vecs = [(f"e{i:02d}", 0, v) for i, v in enumerate(m)] + [(f"c{i:02d}", 0, m[0]) for i in range(15)]
    got = {}
    for r in N.neighbour_lists(*frames(spark, vecs), lists=1, probes=1).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((r.rank, r.near_key, r.cosine))
    assert set(got) == {f"{e}#0" for e, _, _ in vecs}
    assert all([x[0] for x in g] == list(range(1, 11)) and k not in {x[1] for x in g} for k, g in got.items())
    assert [x[1] for x in got["c00#0"]] == [f"c{i:02d}#0" for i in range(1, 11)] and {x[2] for x in got["c14#0"]} == {1.0}
    s, _ = brute(np.vstack([v for _, _, v in vecs]))
    for n, (e, _, _) in enumerate(vecs):
        assert np.allclose([x[2] for x in got[f"{e}#0"]], np.sort(s[n])[::-1][:10], atol=1e-5)


def test_lists_are_of_one_size(spark, monkeypatch):
    """Lists grow in number, not in size; visits stay the same."""
    monkeypatch.setattr(N, "LIST_SIZE", 100)
    m = clustered(1200, 7)
    vecs = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(m)], "id long, vec binary")
    for n in (150, 600, 1200):
        index = N.fit_index(vecs.where(f"id < {n}"))
        assert 0.6 * (n // 100) <= len(index.centroids) <= 1.5 * (n // 100) and index.probes == min(N.PROBES, len(index.centroids))


def test_visits_are_the_nearest_lists():
    m = N._unit(clustered(4000, 9))
    index = N.Index(*N.fit_lists(m, 60), 4, 64)
    assert index.starts[-1] == len(index.centroids) and len(index.groups) == 8  # all groups are looked at
    assert (index.visits(m[:500]) == np.argsort(-(m[:500] @ index.centroids.T), axis=1, kind="stable")[:, :4]).mean() > 0.999
    many = N.Index(*N.fit_lists(m, 400), 4, 64)
    same = many.visits(m[:500])[:, 0] == (m[:500] @ many.centroids.T).argmax(axis=1)
    assert same.mean() > 0.9 and len(set(map(tuple, many.visits(m[:5])))) == 5


def test_numbers_tell_vectors_apart(spark):
    m = clustered(20, 8)
    ev, vi = frames(spark, [(f"e{i}", s, m[i % 7]) for i in range(20) for s in (0, 0)], [(i, m[i]) for i in range(7)])
    keyed = N.usable(N.keyed_vectors(ev, vi))
    distinct = N.distinct_vectors(keyed)
    got = N.members(keyed, distinct).join(distinct, "id").collect()
    assert distinct.count() == 7 and len(got) == 27 and len({r.id for r in got}) == 7
    assert all(bytes(r.vec) == m[int(r.key.split("#")[0][1:]) % 7].tobytes() for r in got if r.key[0] == "e")


def test_empty(spark):
    ev, vi = frames(spark, [])
    assert rows(N.neighbours_found(ev, vi)) == []
