"""What the set join sends to its families, and what stays on disk behind it."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.llm import frames, setjoin
from chunkweave.llm.frames import checkpointed
from tests.llm.test_setjoin import got, plain


def small_families(seed, bases=40):
    """Families of two to five near copies, with as many changes as the threshold allows or one more."""
    r = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"b{b}w{i}" if r.random() < 0.7 else f"c{r.randrange(400)}" for i in range(r.choice([4, 9, 20, 60, 300]))]
        for _ in range(r.choice([2, 2, 3, 4, 5])):
            ws = list(base)
            for _ in range(r.choice([0, 1, 1, 2, len(ws) // 60, len(ws) // 40])):
                ws[r.randrange(len(ws))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws[r.choice([0, 0, 1]) :])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_small_families(spark, n, num):
    rows = small_families(n)
    assert got(spark, rows, n=n, num=num) == plain(rows, n, num)


def test_sketches_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(r.integers(1, 2**63, r.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.integers(0, len(a)) :], r.integers(1, 2**63, r.integers(0, 800), dtype=np.uint64)]))
        assert setjoin.least_difference(setjoin.sketch(a), setjoin.sketch(b)) <= len(np.setxor1d(a, b))


def test_keys_shared_by_chance_make_no_family(spark, monkeypatch):
    """Pairs of texts that share half of their words have keys in common, but their texts need not meet."""
    dealt, checkpointed = [], setjoin.checkpointed

    def watched(df):
        out = checkpointed(df)
        if {"family", "bytes"} <= set(out.columns):
            dealt.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "checkpointed", watched)
    # in slices of their own and in one, as keys go out slice by slice
    rows = [(2 * p + k, " ".join(f"p{p}w{i}" for i in range(150)) + " " + " ".join(f"p{p}k{k}w{i}" for i in range(150))) for k in (0, 1) for p in range(30)]
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1])]
    assert got(spark, rows, n=5, num=80) == plain(rows, 5, 80)
    assert 4 <= dealt[0] <= 6


def test_checkpoints_leave_no_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()

    def files():
        every = env.blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(every.size()) if (f := every.apply(k).getName()).startswith("shuffle_")}

    before = files()
    out = checkpointed(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 10
    assert spark.conf.get(frames.CLEANUP) == "false"
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(path)
    frames.released(out)
    assert not os.path.exists(path)
