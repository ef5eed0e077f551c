"""Connected components against a plain union of sets."""

import random

import pytest

from chunkweave.llm.components import components


def plain(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {x: top(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(-50, 300), r.randrange(300)) for _ in range([50, 200, 120][seed])]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + r.randrange(1, 90)) for _ in range(80)] + [(5, 5), (None, 3), (4, None), edges[0]]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    out = components(df, "a", "b").collect()
    assert len(out) == len({x.node for x in out}) and {x.node: x.component for x in out} == plain(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
