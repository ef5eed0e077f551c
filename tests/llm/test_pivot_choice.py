"""Pivots of tables that are full of copies and of vectors that can't be indexed."""

import numpy as np
import pyarrow as pa

from chunkweave.llm import pivots
from tests.llm.test_pivots import got, plain


def near(r, n, d=16):
    x = r.normal(size=d)
    return [[float(np.float32(v)) for v in x + r.normal(size=d) * 0.02] for _ in range(n)]


def test_one_usable_direction_among_the_first(spark):
    r = np.random.default_rng(1)
    vectors = near(r, 30)
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, [0.0] * 16, 0) for i in range(3000)]
    assert got(spark, rows, pivots=4) == plain(rows)


def test_one_direction(spark):
    rows = [(i, [2.0**i, 2.0 ** (i + 1)], 0) for i in range(20)] + [(99, [1.0, 2.1], 1), (100, [1.0, 2.0], 1)]
    assert got(spark, rows, pivots=1) == plain(rows)


def test_copies_take_one_pivot():
    r = np.random.default_rng(2)
    vectors = [[1.0, 0.0]] * 400 + [[2.0, 0.0]] * 50 + [[0.0, 0.0]] * 9 + r.normal(size=(20, 2)).tolist()
    places = r.permutation(len(vectors)).tolist()
    batch = pa.RecordBatch.from_pydict({"place": places, "id": list(range(len(vectors))), "vector": vectors})
    (out,) = pivots._sampled(12)(iter([batch.slice(0, 300), batch.slice(300)]))
    directions = {tuple(np.round(np.array(v) / np.linalg.norm(v), 6).tolist()) for v in out.column("vector").to_pylist()}
    assert len(directions) == out.num_rows == 12
    firsts = sorted([min(places[:450]), *places[459:]])[:12]
    assert sorted(out.column("place").to_pylist()) == firsts
