"""Search on pruned graphs: recall against brute force, exact scores and ties."""

import numpy as np
import pytest

from chunkweave.llm.graph import Graph, search_all
from chunkweave.llm.queries import op9_pruned_graph

SCHEMA = "vec_id long, embedding array<float>, shard int"


def brute(rows, queries, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in queries:
        d = np.sqrt(((x - np.array(q, np.float32).astype(float)) ** 2).sum(axis=1))
        out[i] = sorted((s, int(j)) for s, j in zip(d.tolist(), ids) if j != i)[:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, [r for r in rows if r[0] % 100 == 0]), found(op9_pruned_graph(spark, sf).collect())
    assert set(got) == set(want)
    hits = [len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want]
    assert np.mean(hits) >= 9.5
    for i, near in got.items():
        assert near == sorted(near) and np.allclose([s for s, _ in near], [np.linalg.norm(np.array(dict(rows)[i]) - np.array(dict(rows)[j])) for _, j in near])


def test_many_shards(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in r.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA).repartition(4)
    got = found(search_all(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=100).collect())
    want = brute(rows, rows[::20], 5)
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want) >= 0.95 * 5 * len(want)


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(100, [1.0, 3.0]), (101, [5.0, 5.0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA).repartition(3)
    got = found(search_all(df, df.where("vec_id in (0, 100, 101)")).collect())
    assert got == brute(rows, [rows[0], rows[50], rows[51]])
    few = found(search_all(df.where("vec_id >= 100"), df.where("vec_id >= 100")).collect())
    assert [len(x) for x in few.values()] == [1, 1]
    assert search_all(df.limit(0), df).count() == 0 and search_all(df, df.limit(0)).count() == 0


def test_odd_vectors_take_no_part(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA)
    got = found(search_all(df, df).collect())
    assert got == {6: [(1.0, 7), (1.0, 7)], 7: [(1.0, 6)]}


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs_reach_all(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    points, _ = Graph.build(x, 8, 16).search(x, 64)
    assert all(set(p[p >= 0].tolist()) == set(range(n)) for p in points)


def test_share_visited_and_recall(capsys):
    r = np.random.default_rng(9)
    x = (r.normal(size=(60, 24))[r.integers(0, 60, 12_000)] + r.normal(size=(12_000, 24)) * 0.7).astype(np.float32)
    graph = Graph.build(x, 64, 48)
    queries = x[::100]
    graph.visits = 0
    found, _ = graph.search(queries, 112)
    away = ((queries[:, None, :] - x[None]) ** 2).sum(axis=2)
    best = np.argsort(away, axis=1)[:, :10]
    recall = np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(found, best)]) / 10
    share = graph.visits / len(queries) / len(x)
    with capsys.disabled():
        print(f"\nvisited {share:.1%} of {len(x)} points, recall {recall:.3f}")
    assert recall >= 0.95 and share < 0.4
