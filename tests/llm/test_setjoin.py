"""The set join against a comparison of all pairs."""

import random

import numpy as np
import pytest

from chunkweave.llm import setjoin
from chunkweave.llm.setjoin import Measure, part_keys, set_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, n=3, num=90, den=100):
    sets = []
    for _, t in rows:
        ws = [w for w in (t or "").translate(LOWER).translate(str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" ") if w]
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    ids, root = [i for i, _ in rows], {i: i for i, _ in rows}
    links = [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (ids[a], ids[b]) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(ids[a]), top(ids[b])))
                root[y] = x
    return sorted(((i, len(s), k, top(i)) for i, s, k in zip(ids, sets, links)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(3)
    return sorted((tuple(r) for r in set_join(df, **kw).collect()), key=str)


def corpus(seed, docs=150):
    r = random.Random(seed)
    vocabulary = [f"W{i}ä" for i in range(3000)]
    line = " ".join(r.choices(vocabulary, k=25))
    bases = [r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 11, 12, 30, 80, 400])) for _ in range(12)]
    rows = []
    for i in range(docs):
        ws = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            at = r.randrange(len(ws) + 1)
            ws[at : at + r.choice([0, 1])] = r.choices(vocabulary, k=r.choice([0, 1, 1]))
        text = " ".join(ws)
        rows.append((i * 3 + 5, text.upper() if r.random() < 0.1 else text + (" " + line if r.random() < 0.1 else "")))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == plain(rows)


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_BYTES", 4_000)
    rows = corpus(7)
    assert got(spark, rows) == plain(rows)


def test_five_words_at_eight_tenths(spark):
    rows = corpus(3, 90)
    assert got(spark, rows, n=5, num=80) == plain(rows, 5, 80)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (None, "a"), (8, "a  b"), (9, "é É"), (10, "É é"), (11, "x y z q"), (11, "x y z q"), (12, "x y z q")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("part", [0, 0.1, 0.9, 1])
@pytest.mark.parametrize("num", [60, 80, 90, 97])
def test_linked_sets_share_a_key(num, part):
    r, measure = np.random.default_rng(num), Measure(num, 100)
    classes = measure.classes(5000)
    for _ in range(400):
        a = r.integers(1, 2**63, r.integers(1, 400), dtype=np.uint64)
        most = measure.differ(len(a), len(a))
        gone = r.integers(0, most // 2 + 1)
        b = np.concatenate([a[gone:], r.integers(1, 2**63, max(0, most // 2 - gone // 2), dtype=np.uint64)])
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * both >= num * either:
            common = np.sort(a[: int(part * len(a))])
            assert len(np.intersect1d(part_keys(np.sort(a), measure, classes, common), part_keys(np.sort(b), measure, classes, common)))
