import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import hnsw


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def clustered(n, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)


def exact(x, k):
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    frame = spark.createDataFrame([(i * 3, v.tolist(), "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, shard string")
    got = {r["vec_id"]: r["neighbours"] for r in hnsw.neighbours(frame, k=10, shard_rows=800, slice_rows=1000).collect()}
    want, d = exact(x, 10)
    assert len(got) == 3000
    hits = 0
    for i in range(3000):
        ids = [n["id"] // 3 for n in got[i * 3]]
        assert len(ids) == 10 == len(set(ids)) and i not in ids
        assert np.allclose([n["distance"] for n in got[i * 3]], d[i, ids], atol=1e-5)
        assert [n["distance"] for n in got[i * 3]] == sorted(n["distance"] for n in got[i * 3])
        hits += len(set(ids) & set(want[i]))
    assert hits / 30_000 >= 0.97


def test_graph_is_flat_bounded_and_connected():
    x = clustered(1500, seed=2)
    g = hnsw.Graph(x, m=8, ef_build=40)
    for at, (nodes, links, row) in enumerate(g.layers):
        assert links.shape == (len(nodes), 16 if at == 0 else 8) and (row[nodes] == np.arange(len(nodes))).all()
        real = links[links >= 0]
        assert (row[real] >= 0).all() and not (links == nodes[:, None]).any()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links)
    reached, queue = {int(g.layers[0][0][0])}, [int(g.layers[0][0][0])]
    nodes, links, row = g.layers[0]
    while queue:
        for n in links[row[queue.pop()]]:
            if n >= 0 and int(n) not in reached:
                reached.add(int(n))
                queue.append(int(n))
    assert len(reached) > 0.995 * len(x)


def test_diverse_selection_equals_plain_loop():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(40, 8))).astype(np.float32)
    ids = np.array([rng.permutation(39)[:12] + 1 for _ in range(5)], dtype=np.int32)
    d = 2 - 2 * np.einsum("qcd,qd->qc", x[ids], x[np.zeros(5, int)])
    got = hnsw.diverse(x, ids, d, 4)
    for q in range(5):
        order = sorted(range(12), key=lambda c: d[q, c])
        kept = []
        for c in order:
            if len(kept) < 4 and all(d[q, c] < 2 - 2 * float(x[ids[q, c]] @ x[ids[q, s]]) for s in kept):
                kept.append(c)
        kept += [c for c in order if c not in kept][: 4 - len(kept)]
        assert set(got[q].tolist()) == {int(ids[q, c]) for c in kept}


def test_copies_ties_and_edge_rows(spark):
    rng = np.random.default_rng(5)
    base = unit(rng.normal(size=(60, 4))).astype(float)
    rows = [(i, base[i % 60].tolist()) for i in range(300)]  # five copies of each
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan"), 0.0, 0.0, 1.0]), (1004, [1.0, 2.0]), (None, base[0].tolist()), (1005, [0.0] * 4), (7, base[7].tolist())]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, id int")
    got = {r["vec_id"]: [(n["id"], n["distance"]) for n in r["neighbours"]] for r in hnsw.neighbours(frame, k=6, shard_rows=100).collect()}
    assert set(got) == {*range(300), 1005}
    for i in range(300):
        copies = [j for j in range(i % 60, 300, 60) if j != i]
        assert [n for n, d in got[i] if d < 1e-6] == copies and len(got[i]) == 6
    assert all(abs(d - 1) < 1e-6 for _, d in got[1005])


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in hnsw.neighbours(one, k=10).collect()} == {1: [2], 2: [1]}
    assert [r["neighbours"] for r in hnsw.neighbours(one.limit(1), k=10).collect()] == [[]]
    assert hnsw.neighbours(one.limit(0)).count() == 0


def test_some_are_asked_of_all_and_few_cells_are_probed(spark):
    """Queries with an id divisible by 20 against all rows, as op6 asks, in many cells of which few are searched."""
    x = clustered(4000, seed=7)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["neighbours"] for r in hnsw.neighbours(frame, shard_rows=100, probes=8, asked=F.col("vec_id") % 20 == 0).collect()}
    want, d = exact(x, 10)
    assert set(got) == set(range(0, 4000, 20))
    assert all(np.allclose([n["distance"] for n in got[i]], d[i, [n["id"] for n in got[i]]], atol=1e-5) for i in got)
    assert sum(len({n["id"] for n in got[i]} & set(want[i])) for i in got) / 2000 >= 0.9


def test_a_third_of_copies_is_one_node(spark):
    x = np.concatenate([np.repeat(clustered(1, seed=8), 700, axis=0), clustered(1400, seed=9)])
    frame = spark.createDataFrame([(i, (v * 2 ** (i % 3)).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(7)
    got = {r["vec_id"]: r["neighbours"] for r in hnsw.neighbours(frame, k=5, shard_rows=200).collect()}
    assert len(got) == 2100 and all(len(n) == 5 for n in got.values())
    for i in (0, 3, 699):
        assert [n["id"] for n in got[i]] == [j for j in range(7) if j != i][:5] and all(n["distance"] < 1e-6 for n in got[i])


def test_cells_beyond_their_number_get_more_shards(spark):
    x = clustered(1200, seed=4)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in hnsw.neighbours(frame, shard_rows=100, cells=3, probes=3).collect()}
    want, _ = exact(x, 10)
    assert sum(len(set(got[i]) & set(want[i])) for i in range(1200)) / 12_000 >= 0.97


def test_as_many_cells_are_searched_as_the_vectors_take(spark):
    """Vectors without clusters, in forty cells: the default number of cells keeps the recall; clusters take few."""
    x = unit(np.random.default_rng(11).normal(size=(2000, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in hnsw.neighbours(frame, shard_rows=50, asked=F.col("vec_id") % 20 == 0).collect()}
    want, _ = exact(x, 10)
    assert sum(len(set(got[i]) & set(want[i])) for i in got) / 1000 >= 0.95
    rng = np.random.default_rng(12)
    tight = unit(np.repeat(rng.normal(size=(8, 24)), 50, axis=0) + 0.05 * rng.normal(size=(400, 24))).astype(np.float32)
    cells = hnsw.centroids(tight[::2], 8)
    nodes = spark.createDataFrame([(v.tolist(), int((v @ cells.T).argmax())) for v in tight], "v array<float>, c int").repartition(3)
    ranks = lambda v: np.argsort(-(v @ cells.T), axis=1)
    assert hnsw._enough(nodes, tight[:40], ranks(tight[:40]), 10, 0.98) <= 2
