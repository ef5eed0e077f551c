"""Mixing against water-filling and a queue in plain Python."""

import hashlib
import re

import pytest

from chunkweave.llm.mixing import mix, mixture


def plain(rows, weights=(5, 2, 1), epochs=3):
    """rows: (doc_id, text, source). Targets by repeated sharing out, copies by one sorted queue."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    target, left, open_ = {}, float(sum(size)), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if epochs * total[s] <= level * weight[s]}
        for s in over or open_:
            target[s] = float(epochs * total[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    even = lambda i: int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:15], 16)
    queue = []
    for s in names:
        before = 0
        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (even(rows[k][0]), rows[k][0] is not None, rows[k][0] or 0, size[k])):
            i = -(2**63) if rows[k][0] is None else rows[k][0]
            queue += [((e * total[s] + before + size[k]) / weight[s], even(rows[k][0]), i, size[k], e, k) for e in range(epochs)]
            before += size[k]
    taken, served = [0] * len(rows), 0
    for *_, n, _, k in sorted(queue):
        served += n
        if served > sum(size):
            break
        taken[k] += n
    return sorted(((r[0], r[2], n, total[r[2]], round(target[r[2]], 6), t) for r, n, t in zip(rows, size, taken)), key=str)


def got(spark, rows, slices):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string").repartition(3)
    return sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix(df, slices=slices).collect()), key=str)


@pytest.mark.parametrize("slices", [1, 64])
def test_against_a_plain_queue(spark, slices):
    rows = [(i, " ".join("w" * (1 + i * 37 % 90)), ["a", "b", "B", "é", None][min(4, i * i % 11 // 2)]) for i in range(300)]
    rows += [(900, None, "z"), (901, "", "z"), (None, "one two", "a"), (7, rows[7][1], rows[7][2])]
    assert got(spark, rows, slices) == plain(rows)


def test_small_sources_stop_at_three_times(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(i, "w " * 10, "b") for i in range(10, 60)]
    out = got(spark, rows, 8)
    assert {r[5] for r in out if r[1] == "a"} == {30} and {r[4] for r in out if r[1] == "a"} == {90.0}
    assert out == plain(rows)


def test_empty_tables(spark):
    assert got(spark, [], 8) == []
    assert [r[5] for r in got(spark, [(1, None, None)], 8)] == [0]


def test_mixture_is_in_order_of_service(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mix(docs).cache()
    out = mixture(mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(len(r.finish) for r in mixed.collect() if r["size"])
    for s, near in {(r.source, r.target) for r in mixed.collect()}:
        rows = [r for r in mixed.collect() if r.source == s]
        assert abs(sum(r.taken for r in rows) - near) <= max(r["size"] for r in rows) + 1
