"""Search on pruned graphs over vectors whose squares are out of the range of floats."""

import numpy as np
import pytest

from chunkweave.llm.graph import search_all
from tests.llm.test_graph import SCHEMA, brute, found


@pytest.mark.parametrize("large,small", [(1e30, 1e30), (1e-30, 1e-30), (1e30, 1e-3), (1e25, 1e-25)])
def test_extreme_magnitudes(spark, large, small):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in r.normal(size=8) * (large if i % 2 else small)]) for i in range(400)]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA).repartition(3)
    got, want = found(search_all(df, df.where("vec_id % 20 < 2")).collect()), brute(rows, [x for x in rows if x[0] % 20 < 2])
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want) >= 9.5 * len(want)
    assert all(np.allclose([s for s, _ in got[i]], [float(np.linalg.norm(np.array(dict(rows)[i]) - np.array(dict(rows)[j]))) for _, j in got[i]], atol=0) for i in got)
