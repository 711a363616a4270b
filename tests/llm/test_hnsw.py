import math
import tracemalloc

import numpy as np
import pytest

from bytemill.llm import hnsw


def data(n, seed, d=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(n):
        if i % 3 == 1:
            x[i] = x[i - 1] + r.normal(size=d) * r.choice([0.05, 0.2, 0.45])
        if i % 5 == 0:
            x[i] = x[0] + r.normal(size=d) * 0.06
    x[7], x[9] = x[4], 2 * x[4]
    return x


def brute(ids, vectors, least):
    fine = [v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) and i is not None for i, v in zip(ids, vectors)]
    n = len(ids)
    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and fine[a] and fine[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a]), np.array(vectors[b])
                links[a, b] = x @ y / math.sqrt((x @ x) * (y @ y)) >= least
    comp = list(range(n))
    for a in range(n):
        stack, group = [a], {a}
        while stack:
            for b in np.flatnonzero(links[stack.pop()]).tolist():
                if b not in group:
                    group.add(b)
                    stack.append(b)
        comp[a] = min((ids[i] for i in group if ids[i] is not None), default=None)
    return sorted(((i, int(links[k].sum()), comp[k], i == comp[k] or i is None) for k, i in enumerate(ids)), key=repr)


def test_graph_finds_what_brute_force_finds():
    x = data(3000, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    beam, recall = hnsw.audited(graph, x, 0.9)
    assert recall >= hnsw.RECALL
    query, node = graph.within(x.astype(np.float32), 0.9, beam)
    found, want = set(zip(query.tolist(), node.tolist())), set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9))))
    assert len(found & want) >= 0.99 * len(want)


@pytest.mark.parametrize("recall", [1.1, hnsw.RECALL])
def test_a_shard_whose_audit_fails_is_searched_by_brute_force(monkeypatch, recall):
    monkeypatch.setattr(hnsw, "RECALL", recall)
    x = data(200, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    beam, found = hnsw.audited(graph, x, 0.9)
    assert (beam == 0) == (recall > 1) and found <= 1
    ids = np.arange(200)
    arrays = {"ids": ids, "weight": np.ones(200, np.int64), "x": x, "beam": np.array(beam), **{f"links{k}": v for k, v in enumerate(graph.links)}}
    rep, links, _ = hnsw._Shard(hnsw._packed(arrays), 0.9).answer(ids, x)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert dict(zip(rep.tolist(), links.tolist())) == {i: int(n) for i, n in enumerate(want) if n}


@pytest.mark.parametrize("beam", [32, 0])
def test_memory_does_not_grow_with_a_dense_group(beam):
    """All of 3000 vectors link to each other: nine million links, of which a few are held at once, and none is lost."""
    r = np.random.default_rng(1)
    x = np.ones((3000, 16)) + 0.02 * r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    arrays = {"ids": np.arange(3000), "weight": np.full(3000, 2), "x": x, "beam": np.array(beam), **{f"links{k}": v for k, v in enumerate(hnsw.Graph(x).links)}}
    shard = hnsw._Shard(hnsw._packed(arrays), 0.9)
    tracemalloc.start()
    try:
        rep, links, other = shard.answer(np.arange(512), x[:512])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 128 << 20
    assert rep.tolist() == list(range(512)) and (links == 2 * 2999).all() and (other != rep).all()
    assert len(np.unique(shard.roots(np.arange(3000)))) == 1


def test_rows_equal_brute_force(spark, monkeypatch):
    for name, value in (("SHARDS", 3), ("SLICE", 40), ("PART", 5000)):
        monkeypatch.setattr(hnsw, name, value)
    x = data(260, 2).astype(np.float32)
    vectors = [v.tolist() for v in x]
    ids = list(range(260))
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [3.0], vectors[3], vectors[3]]
    vectors, ids = vectors + odd, ids + [500 + i for i in range(len(odd) - 2)] + [3, None]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, links int")
    out = hnsw.near_duplicates(df).collect()
    assert {r.recall for r in out} <= {1.0} or min(r.recall for r in out) >= hnsw.RECALL
    got = sorted((tuple(r)[:4] for r in out), key=repr)
    assert got == brute(ids, vectors, 0.9)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
