"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest

from chunkweave.llm import pivots
from chunkweave.llm.pivots import near_vectors
from chunkweave.llm.queries import op4_pivot_permutations

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def plain(rows, least=0.93):
    """rows: (vec_id, vector, label), one row for each vec_id."""
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            fine[i] = (len(v), label, x / np.sqrt((x * x).sum()))
    root = {i: i for i in fine}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(fine, 0)
    for a in fine:
        for b in fine:
            if b < a and fine[a][:2] == fine[b][:2] and fine[a][2] @ fine[b][2] >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(((i, links.get(i, 0), top(i) if i in fine else i, i is not None and (i not in fine or top(i) == i)) for i, *_ in rows), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in near_vectors(df, **kw).collect()), key=str)


def clusters(seed, n=400, d=32):
    r = np.random.default_rng(seed)
    centres, rows = r.normal(size=(20, d)), []
    for i in range(n):
        x = centres[r.integers(20)] + r.normal(size=d) * r.choice([0, 0.05, 0.2, 0.4])
        rows.append((i * 3 + 1, [float(np.float32(v)) for v in x], int(r.integers(3))))
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = clusters(block)
    out, want = got(spark, rows), plain(rows)
    assert sum(x[1] for x in out) >= 0.99 * sum(x[1] for x in want) and all(a[1] <= b[1] for a, b in zip(out, want))
    assert got(spark, rows, shared=1, nearest=128) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 4, 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [nan, 1, 1, 1], 1), (6, [inf, 1, 1, 1], 1), (7, [1.0, 2, 3, 4], None), (8, [1.0, 2, 3, 4], 2), (9, [2.0, 4, 6, 8], 2), (10, [1.0, 2, 3], 2), (11, [1.0, 2, 3], 2), (12, [1.0, 2, 3, 4], 3), (None, [1.0, 2, 3, 4], 2), (13, [1e-30, 2e-30, 3e-30, 4e-30], 2), (14, [3e38, 0, 0, 0], 5), (15, [3e38, 1, 1, 1], 5)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_repeated_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 1.0], 0)]
    assert got(spark, rows) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_all_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op4_pivot_permutations(spark, sf).collect()), key=str) == plain(rows)
