"""Chunking, dedup, sketches, segments, stores, similarity: invariants and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from chunkweave.operators import chunking, dedup, segments, similarity, sketch, store
from chunkweave.params import ChunkParams, FrequencyParams, PackParams, SegmentParams, SparseParams, from_json, to_json

SMALL = ChunkParams(min=64, avg=128, max=256)


def slow_cuts(data, p):
    """The same cut rule, a byte at a time."""
    import math

    bits, ends, start = round(math.log2(p.avg)), [], 0
    normal = min(p.avg - min(p.min + -(-p.min // 2), p.avg), p.max)
    while start < len(data):
        chunk, fp = data[start:], 0
        i = min(len(chunk), p.min)
        while i < min(p.max, len(chunk)):
            fp = (fp >> 1) + p.gear[chunk[i]] & 0xFFFFFFFF
            mask = (1 << (bits + 1 if i < normal else bits - 1)) - 1
            i += 1
            if not fp & mask:
                break
        start += i
        ends.append(start)
    return ends


def frame(spark, contents):
    return spark.createDataFrame([(i, "s", None if c is None else bytearray(c)) for i, c in enumerate(contents)], "file_id long, source string, content binary").withColumn("file_size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))


CONTENTS = [b"", None, b"x" * 10, bytes(5000), random.Random(1).randbytes(64), random.Random(2).randbytes(256), random.Random(3).randbytes(3000), "é".encode() * 777]


@pytest.mark.parametrize("params", [SMALL, ChunkParams(), ChunkParams(min=16, avg=64, max=64), ChunkParams(min=8, avg=256, max=300)])
def test_cut_points(params):
    contents = [c or b"" for c in CONTENTS] + [random.Random(9).randbytes(60_000)]
    assert [chunking.cut_points(c, params) for c in contents] == [slow_cuts(c, params) for c in contents]


@pytest.mark.parametrize("params", [SMALL, ChunkParams(method="fixed", avg=100), ChunkParams(method="fixed", avg=100, block=250)])
def test_chunks_make_the_file(spark, params):
    out = {}
    for r in chunking.chunk(frame(spark, CONTENTS), params).orderBy("file_id", "pos").collect():
        assert r.offset == len(out.get(r.file_id, b"")) and r.size == len(r.data)
        out[r.file_id] = out.get(r.file_id, b"") + bytes(r.data)
    assert out == {i: c for i, c in enumerate(CONTENTS) if c}


def test_an_insertion_changes_few_chunks(spark):
    data = random.Random(4).randbytes(20_000)
    rows = chunking.fingerprinted(chunking.chunk(frame(spark, [data, b"!" + data]), SMALL)).collect()
    a, b = ({r.fp for r in rows if r.file_id == i} for i in (0, 1))
    assert len(b - a) <= 4
    two = chunking.two_level_chunks(frame(spark, [data]), ChunkParams(min=1024, avg=2048, max=4096), SMALL).orderBy("pos").collect()
    assert b"".join(bytes(r.data) for r in two) == data and [r.pos for r in two] == list(range(len(two))) and two[-1].segment > 2


def meta(spark, n=600, kinds=80, files=4, seed=5):
    r = random.Random(seed)
    rows = [(i % files, "ab"[i % 2], i // files, r.choice([10, 20, 30]), f"{r.randrange(kinds):064x}"[::-1]) for i in range(n)]
    return spark.createDataFrame(rows, "file_id long, source string, pos int, size int, fp string"), rows


def test_dedup(spark):
    df, rows = meta(spark)
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    seen, firsts = set(), set()
    for r in rows:
        if r[4] not in seen:
            firsts.add((r[0], r[2]))
        seen.add(r[4])
    assert {(r.file_id, r.pos) for r in dedup.first_occurrence(df).where("is_first = 1").collect()} == firsts
    for mode in ("out_enclave", "in_enclave", "frequency"):
        assert dedup.unique_chunks(df, mode).agg(F.sum("is_unique")).first()[0] == len(seen)
    with pytest.raises(ValueError):
        dedup.unique_chunks(df, "similarity")
    assert dedup.totals(df).first().unique_chunks == len(seen)
    assert dedup.totals(df.limit(0)).first().dedup_ratio is None
    a, b = df.where("file_id < 2"), df.where("file_id >= 2").where("pos < 30")
    index = b.groupBy("fp").agg(F.min("file_id").alias("at"))
    probed = dedup.probe(a, index)
    assert probed.count() == a.count() and dedup.missing(a, b).count() == probed.where("dedup_flag = 'UNIQUE'").count() and dedup.shared(a, b).count() == probed.where("dedup_flag = 'DUPLICATE'").count()


def test_sketch(spark):
    df, rows = meta(spark, kinds=300)
    params = FrequencyParams(width=64)
    true = {r.fp: r.freq for r in sketch.frequencies(df).collect()}
    halves = sketch.merged(sketch.sketch(df.where("file_id < 2"), params), sketch.sketch(df.where("file_id >= 2"), params))
    got = {r.fp: r.estimate for r in sketch.estimates(df, halves, params).collect()}
    assert got == {r.fp: r.estimate for r in sketch.estimates(df, sketch.sketch(df, params), params).collect()}
    assert all(got[fp] >= n for fp, n in true.items())
    index = sketch.FrequencyIndex(FrequencyParams(width=1 << 16, top=5, batch=16))
    fps = [r[4] for r in rows]
    for i in range(0, len(fps), 16):
        out = index.batch(fps[i : i + 16])
        assert [t for _, t in out].count("LOCAL") == len(fps[i : i + 16]) - len(set(fps[i : i + 16]))
    assert len(index.kept) == 5 and min(index.kept.values()) >= sorted(true.values())[-20]
    replayed = sketch.replay(df, "source", FrequencyParams(width=1 << 16, top=5, batch=16))
    assert replayed.count() == len(rows) and replayed.where("tier = 'TOP'").count() > 0


def test_segments(spark):
    df, rows = meta(spark, files=2)
    params = SegmentParams(min_bytes=100, max_bytes=300, max_chunks=9, divisor=5, pattern=1)
    got = {(r.file_id, r.pos): r.segment for r in chunking.segment(df, params).collect()}
    for f in (0, 1):
        number = count = total = 0
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: r[2]):
            cut = sum(bytes.fromhex(r[4])) % 5 == 1
            if count and (count >= 9 or total + r[3] > 300 or total >= 100 and cut):
                number, count, total = number + 1, 0, 0
            assert got[f, r[2]] == number
            count, total = count + 1, total + r[3]


def test_near_exact_indexes_miss_but_never_invent(spark):
    df, rows = meta(spark, kinds=200)
    cut = chunking.fixed_segments(df, 8)
    exact = len({r[4] for r in rows})
    assert segments.extreme_binning(cut).agg(F.sum("is_unique")).first()[0] >= exact
    one = cut.withColumn("lane", F.lit(1))
    for params in (SparseParams(sample_bits=1), SparseParams(sample_bits=6)):
        assert segments.sparse_indexing(one, "lane", params).agg(F.sum("is_unique")).first()[0] >= exact
    index = segments.SparseIndex(SparseParams(sample_bits=1))
    fps = [f"{i:02x}" + "0" * 62 for i in range(0, 250, 25)]
    assert index.segment(fps) == [True] * 10 and index.segment(fps) == [False] * 10 and len(index.manifests) == 1


def test_packing_limits(spark):
    df, rows = meta(spark)
    params = PackParams(container_bytes=400, meta_bytes=56 * 6)
    out = store.packed(df, "source", ("file_id", "pos"), params).collect()
    assert len(out) == len(rows)
    by = {}
    for r in sorted(out, key=lambda r: (r.source, r.file_id, r.pos)):
        by.setdefault((r.source, r.container), []).append(r)
    for key, members in by.items():
        at = 0
        for r in members:
            assert r.container_offset == at
            at += r.size + 16
        assert len(members) == 1 or (16 + members[-1].size + members[-1].container_offset + 56 * len(members) < 400 and 56 * len(members) < 56 * 6)
        following = by.get((key[0], key[1] + 1))
        if following:  # the next chunk did not fit
            n, body, rows_ = following[0].size, at, 56 * len(members)
            assert not (16 + n + body + 56 + rows_ < 400 and 56 + rows_ < 56 * 6)


def test_lru(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("abacbdab")], "lane int, i int, k string")
    assert [r.hit for r in store.lru_hits(df, "lane", "k", ("i",), 2).orderBy("i").collect()] == [0, 0, 1, 0, 0, 0, 0, 0]


def test_containers_and_restore_errors(spark):
    stored = spark.createDataFrame([("a", 0, "f0", 3, bytearray(b"abc"))], "container_id string, offset long, fp string, size int, data binary")
    ids = spark.createDataFrame([("a",), ("b",)], "container_id string")
    assert {(r.container_id, r["size"]) for r in store.containers_of(ids, stored, must_exist=False).collect()} == {("a", 3), ("b", 0)}
    with pytest.raises(Exception, match="no container b"):
        store.containers_of(ids, stored).collect()
    recipe = spark.createDataFrame([(1, 0, "f0", "a", 0), (1, 1, "f0", "a", 0), (1, 2, "f9", "b", 0)], "file_id long, pos int, fp string, container_id string, offset long")
    row = store.restored(recipe.where("pos < 2"), stored).first()
    assert bytes(row.content) == b"abcabc" and row.n_chunks == 2
    with pytest.raises(Exception, match="no chunk for f9"):
        store.restored(recipe, stored).collect()


def test_similarity(spark):
    old = spark.createDataFrame([("o1", [1, 2, 3], 1), ("o2", [1, 7, 8], 2)], "fp string, features array<long>, at int")
    new = spark.createDataFrame([(1, 0, "n0", [1, 7, 3]), (1, 1, "n1", [50, 51, 52]), (1, 2, "n2", [50, 60, 61]), (1, 3, "n3", [60, 61, 70])], "file_id long, pos int, fp string, features array<long>")
    rows = {r.fp: (r.tag, r.base_fp) for r in similarity.tagged(new, similarity.feature_index(old, "at"), "file_id", ("pos",)).collect()}
    assert rows == {"n0": ("SIMILAR", "o2"), "n1": ("NON_SIMILAR", None), "n2": ("BATCH_SIMILAR", "n1"), "n3": ("NON_SIMILAR", None)}


def test_params_as_json():
    p = ChunkParams(min=1, avg=2, max=3)
    assert from_json(ChunkParams, to_json(p)) == p
    with pytest.raises(ValueError):
        from_json(ChunkParams, '{"mix": 1}')
    with pytest.raises(ValueError):
        ChunkParams(min=9, avg=2, max=3)


def test_checks_and_counters(spark):
    df, rows = meta(spark)
    a, b = df.where("file_id < 2"), df.where("file_id >= 2")
    tiers = {r.tier: r.n for r in dedup.tiered_probe(a, b.where("pos < 9"), b).groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert sum(tiers.values()) == a.count() and tiers["CACHE"] + tiers["INDEX"] == dedup.shared(a, b).count()
    assert dedup.unexpected(a.where("pos > 3"), a).isEmpty() and not dedup.unexpected(a, a.limit(1)).isEmpty()
    same, seen = dedup.observed(df, "chunks")
    same.write.format("noop").mode("overwrite").save()
    assert seen.get == {"chunks": len(rows), "bytes": sum(r[3] for r in rows)}
    recipe = spark.createDataFrame([(1, 0, "f")], "file_id long, pos int, fp string")
    wanted = spark.createDataFrame([(1,), (2,)], "file_id long")
    assert store.wanted_recipes(wanted, recipe, must_exist=False).count() == 1 and store.wanted_recipes(wanted.limit(1), recipe).count() == 1
    with pytest.raises(Exception, match="no recipe of file 2"):
        store.wanted_recipes(wanted, recipe).collect()
