"""Uploads into a store, by mode, with codecs and ciphers; folders by hash; SQL names; small helpers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chunkweave.__main__ import main
from chunkweave.functions import codecs, hashing
from chunkweave.functions.register import register
from chunkweave.operators import store
from chunkweave.plans import catalog, sync
from chunkweave.sources import files as sources
from tests.test_plans import PARAMS, contents


@pytest.fixture(scope="module")
def rows(spark):
    one = bytes(range(256)) * 40
    data = [(1, "a", one), (2, "a", one[:5000] + b"x" + one[5000:]), (3, "b", b""), (4, "b", one * 2), (5, "c", None), (6, "a", hashlib.sha256(b"q").digest() * 100)]
    return spark.createDataFrame([(i, s, None if c is None else bytearray(c)) for i, s, c in data], "file_id long, source string, content binary").withColumn("file_size", F.octet_length("content").cast("long")).cache()


@pytest.mark.parametrize("mode", range(5))
def test_modes_restore_all(rows, mode):
    cloud = sync.upload(rows, PARAMS, mode=mode)
    assert contents(sync.restore(cloud)) == {r.file_id: bytes(r.content or b"") for r in rows.collect()}
    exact = sync.upload(rows, PARAMS).meta.count()
    total = sync.totals(cloud).first()
    assert total.stored_chunks >= exact and (mode in (2, 3) or total.stored_chunks == exact)
    assert total.compressed_bytes <= total.stored_bytes <= total.logical_bytes


@pytest.mark.parametrize("mode", [0, 2, 4])
def test_upload_into_a_store(rows, mode):
    first = sync.upload(rows.where("file_id < 4"), PARAMS, name="a", mode=mode).persisted()
    both = sync.upload(rows.where("file_id >= 4"), PARAMS, name="b", into=first, mode=mode).persisted()
    assert contents(sync.restore(both)) == {r.file_id: bytes(r.content or b"") for r in rows.collect()}
    assert both.meta.groupBy("fp").count().where("count > 1").isEmpty()
    again = sync.upload(rows.withColumn("file_id", F.col("file_id") + 100), PARAMS, name="c", into=both, mode=mode)
    assert again.stored().count() == both.stored().count() and again.recipes.count() == 2 * both.recipes.count()


def test_mode_3_has_no_state_to_go_on_from(rows):
    with pytest.raises(ValueError):
        sync.upload(rows, PARAMS, into=sync.upload(rows, PARAMS), mode=3)


def test_cli_modes_and_second_upload(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
    (tmp_path / "one/a").write_bytes(b"abc" * 4000)
    (tmp_path / "one/empty").write_bytes(b"")
    (tmp_path / "two/b c").write_bytes(b"abc" * 4000 + b"!")
    main(["upload", str(tmp_path / "one"), str(tmp_path / "s1"), "-m", "2"], spark)
    main(["upload", str(tmp_path / "two"), str(tmp_path / "s2"), "-m", "2", "--into", str(tmp_path / "s1"), "--name", "again"], spark)
    main(["restore", str(tmp_path / "s2"), str(tmp_path / "out")], spark)
    assert sorted(bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([b"", b"abc" * 4000, b"abc" * 4000 + b"!"])


def test_sealed_chunks(spark):
    df = spark.createDataFrame([("a", bytearray(b"abc" * 100)), ("b", bytearray(b"x")), ("c", bytearray())], "fp string, data binary")
    want = {r.fp: bytes(r.data) for r in df.collect()}
    for codec in ("zstd", "zlib", "lz4"):
        for cipher in (None, "GCM", "CBC", "CFB"):
            key = None if cipher is None else F.lit("k" * 16)
            stored = sync.sealed(df, codec, key, cipher or "GCM")
            assert {r.fp: bytes(r.data) for r in sync.opened(stored, key, cipher or "GCM").collect()} == want
    with pytest.raises(ValueError):
        codecs.compress(b"", "none")


def test_recipes_sealed_and_in_folders(spark, tmp_path):
    recipe = spark.createDataFrame([(i, p, f"f{i}{p}", f"c-{p}", p * 10, 5) for i in range(40) for p in range(3)], "file_id long, pos int, fp string, container_id string, offset long, length int")
    sealed = sources.sealed_recipes(recipe, F.lit("k" * 32))
    back = sources.opened_recipes(sealed, F.lit("k" * 32), "fp string, container_id string, offset long, length int")
    assert sorted(back.collect()) == sorted(recipe.collect())
    path = str(tmp_path / "r")
    sources.write_recipes(recipe, path)
    assert sorted(sources.read_recipes(spark, path).select(recipe.columns).collect()) == sorted(recipe.collect())
    assert sources.read_recipes(spark, path, 7, 9).count() == 6
    box = recipe.select("container_id", "offset", "fp").distinct()
    sources.write_containers(box, str(tmp_path / "c"))
    assert sources.read_containers(spark, str(tmp_path / "c"), "c-1").count() == 40 == sources.read_containers(spark, str(tmp_path / "c")).count() / 3


def test_names_for_sql(spark):
    names = register(spark, "t_")
    row = spark.sql("SELECT t_hmac_sha3(x) a, t_xxh64(x) b, t_murmur3(x) c, size(t_features(x)) d, t_unpack('lz4', t_lz4(repeat('ab', 99))) e, t_undelta(x, t_delta(x, concat(x, x))) f, t_xxh64(NULL) g FROM VALUES (CAST('abc' AS BINARY)) AS t(x)").first()
    assert "t_content_chunks" in names and row.b == 4952883123889572249 and row.d == 3 and bytes(row.e) == b"ab" * 99 and bytes(row.f) == b"abcabc" and row.g is None
    cut = spark.sql("SELECT * FROM t_content_chunks(CAST(repeat('abcdefgh', 9000) AS BINARY))").collect()
    assert sum(r.size for r in cut) == 72_000 and [r.pos for r in cut] == list(range(len(cut)))


def test_helpers(spark):
    df = spark.createDataFrame([(bytearray(range(1, 13)),), (bytearray(),)], "d binary")
    rows = df.select(hashing.to_hex(F.col("d")).alias("h"), hashing.swapped(F.col("d")).alias("s"), hashing.from_base64(hashing.to_base64(F.col("d"))).alias("b"), hashing.from_hex(hashing.to_hex(F.col("d"))).alias("x")).collect()
    assert [bytes(r.s) for r in rows] == [bytes(range(12, 0, -1)), b""] and rows[0].h == bytes(range(1, 13)).hex() and all(r.b == r.x for r in rows)
    assert df.select(hashing.little_u64(F.col("d"), 2)).first()[0] == int.from_bytes(bytes(range(3, 11)), "little")
    assert hashing.murmur3_x86_128(b"") == (0, 0, 0, 0)
    lines = spark.createDataFrame([("aa:bb:cc:dd:ee:ff 12",), ("rubbish",), (None,)], "value string")
    assert sources.malformed(lines, 6).count() == 2 and sources.parse_trace(lines, 6, 100).count() == 1


def test_container_cache(spark):
    held = {"c1": ["a", "b"], "c2": ["c"], "c3": ["d"]}
    where = {f: c for c, fs in held.items() for f in fs}
    asked = ["a", "b", "c", "a", "d", "c", "a", "zz"]
    df = spark.createDataFrame([("s", k, f, where.get(f), held.get(where.get(f)), [ord(f[0])], [ord(x) for x in held.get(where.get(f), [])]) for k, f in enumerate(asked)], "lane string, k int, fp string, container_id string, fps array<string>, features array<long>, container_features array<long>")
    out = store.container_cache(df, "lane", ("k",), 2, "features").orderBy("k").collect()
    assert [r.hit for r in out] == [0, 1, 0, 1, 0, 0, 0, 0] and [r.similar for r in out] == [0, 1, 0, 1, 0, 0, 0, 0]


def test_synthetic_data_compresses_as_asked(spark):
    for ratio in (1.5, 2.0, 4.0):
        made = sources.synthetic(spark, 300_000, ratio, seed=5).withColumn("c", codecs.compressed(F.col("content"), "zlib"))
        n, packed = made.agg(F.sum("file_size"), F.sum(F.octet_length("c.bytes"))).first()
        assert 0.5 * ratio < n / packed < 2 * ratio


def test_catalog_has_no_row_filters_for_sql():
    assert all("n > 0" not in sql and "file_id < 10" not in sql for sql in catalog.SQL.values())
