"""Hashes, features and codecs against known values and plain versions."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkweave.functions import codecs, features, hashing, scalars

ABC = bytearray(b"abc")


def test_known_hashes(spark):
    row = spark.createDataFrame([(ABC,)], "d binary").select(hashing.hmac_sha3(F.col("d")).alias("a"), hashing.xxh64(F.col("d")).alias("b"), *[hashing.fingerprint(F.col("d"), k).alias(k) for k in ("sha256", "sha1", "md5")]).first()
    assert row.a == "776bdf4f598121a2ac38c408d375731a5681f10998e77dcb92fb474adfef8f90" and row.b == 4952883123889572249
    assert (row.sha256, row.sha1, row.md5) == tuple(hashlib.new(k, b"abc").hexdigest() for k in ("sha256", "sha1", "md5"))
    assert [hashing.murmur3_32(x) for x in (b"", b"test", b"Hello, world!")] == [0, 0xBA6BD213, 0xC0363E43]
    assert [hashing.murmur3_x64_128(x) for x in (b"", b"hello")] == [(0, 0), (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)]
    assert spark.createDataFrame([(None,)], "d binary").select(hashing.hmac_sha3(F.col("d"))).first()[0] is None


def test_numbers_of_a_fingerprint(spark):
    fp = hashlib.sha256(b"x").hexdigest()
    raw = bytes.fromhex(fp)
    row = spark.createDataFrame([(fp, "00" + fp[2:], "04" + fp[2:])], "a string, b string, c string").select(hashing.byte_sum(F.col("a")).alias("s"), *[hashing.little_u32(F.col("a"), i).alias(f"w{i}") for i in range(4)], hashing.is_hook(F.col("b")).alias("b"), hashing.is_hook(F.col("c")).alias("c")).first()
    assert row.s == sum(raw) and [row[f"w{i}"] for i in range(4)] == np.frombuffer(raw, "<u4")[:4].tolist() and row.b and not row.c


def test_encryption_and_keys(spark):
    df = spark.createDataFrame([(ABC, "k" * 32, "file", "me")], "d binary, k string, n string, c string")
    assert bytes(df.select(hashing.decrypt(hashing.encrypt(F.col("d"), F.col("k")), F.col("k"))).first()[0]) == b"abc"
    a, b = df.select(hashing.name_key(F.col("n"), F.col("c")), hashing.name_key(F.col("n"), F.lit("you"))).first()
    assert len(a) == 64 and a != b


def slow_rabin(data):
    """Bit by bit: the window's bytes as a polynomial, divided by the fixed one."""
    out = []
    for i in range(len(data)):
        value = 0
        for byte in data[max(0, i - 47) : i + 1]:
            value = value << 8 | byte
            while value.bit_length() > 63:
                value ^= features.POLYNOMIAL << (value.bit_length() - 64)
        out.append(value)
    return out


def test_rolling_fingerprint():
    data = random.Random(1).randbytes(120)
    assert features.rolling(np.frombuffer(data, np.uint8)).tolist() == slow_rabin(data)


def plain_features(data):
    part = len(data) // 12
    parts = [data[i * part : (i + 1) * part if i < 11 else len(data)] for i in range(12)]
    most = [max(slow_rabin(p), default=0) for p in parts]
    groups = [sorted(most[g : g + 3], reverse=True) for g in range(0, 12, 3)]
    return [xxhash.xxh64_intdigest(b"".join(g[i].to_bytes(8, "little") for g in groups)) for i in range(3)]


def test_super_features_survive_an_edit(spark):
    data = bytearray(random.Random(2).randbytes(4000))
    edited = bytearray(data)
    edited[100] ^= 255
    rows = [r.f for r in spark.createDataFrame([(data,), (edited,), (bytearray(),), (ABC,)], "d binary").select(features.features(F.col("d")).alias("f")).collect()]
    assert len(set(rows[0]) & set(rows[1])) >= 1 and all(len(r) == 3 for r in rows)
    assert rows[0] == [hashing.signed(x) for x in plain_features(bytes(data))]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 300), st.binary(max_size=20)), max_size=5))
def test_delta_round_trip(base, edits):
    target = bytearray(base * 2)
    for at, new in edits:
        target[at : at + len(new) // 2] = new
    assert codecs.undelta(base, codecs.delta(base, bytes(target))) == bytes(target)


def test_delta_is_small_and_codecs_return(spark):
    base = random.Random(3).randbytes(5000)
    target = base[:2000] + b"inserted" + base[2000:]
    assert len(codecs.delta(base, target)) < 40
    for codec in ("zstd", "zlib"):
        for data in (b"", b"a" * 1000, base):
            assert codecs.decompress(*codecs.compress(data, codec)) == data
    assert codecs.compress(base)[0] == "raw"
    out = spark.createDataFrame([(bytearray(b"a" * 1000),), (None,)], "d binary").withColumn("c", codecs.compressed(F.col("d"))).select("d", codecs.decompressed(F.col("c.codec"), F.col("c.bytes")).alias("e")).collect()
    assert all(r.d == r.e for r in out)


def test_scalars(spark):
    row = spark.range(1).select(scalars.div_ceil(F.lit(4097), 4096).alias("a"), scalars.clamp(F.lit(9), 1, 5).alias("b"), scalars.ordinal_id(F.lit(37)).alias("c"), scalars.ratio(F.lit(10), F.lit(4)).alias("d"), scalars.ratio(F.lit(1), F.lit(0)).alias("e"), scalars.mib_per_second(F.lit(1 << 21), F.lit(2.0)).alias("f")).first()
    assert tuple(row) == (2, 5, "00000011", 2.5, None, 1.0)
    ratios = [r[0] for r in spark.range(2000).select(scalars.sampled_ratio(F.col("id").cast("string"))).collect()]
    assert min(ratios) > 1 and abs(sum(ratios) / 2000 - 2) < 0.05


def test_features_of_many_chunks():
    r = random.Random(8)
    chunks = [r.randbytes(n) for n in (0, 1, 11, 12, 13, 600, 1300, 5, 0)] + [bytes(700)]
    assert features.super_features(chunks) == [plain_features(c) for c in chunks]
