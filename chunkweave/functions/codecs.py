"""Compression and delta coding of chunks."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "codec string, bytes binary"
#: Before an LZ4 block: the length of what it holds.
LENGTH = struct.Struct("<I")
#: Bytes of a block that a delta may copy, at least.
COPY = 16


def compress(data: bytes, codec: str = "zstd") -> tuple[str, bytes]:
    """The codec used (zstd, zlib or lz4) and the bytes: raw if compression gains nothing."""
    if codec not in ("zstd", "zlib", "lz4"):
        raise ValueError(f"no codec is called {codec}")
    if codec == "lz4":
        packed = LENGTH.pack(len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    else:
        packed = zstandard.ZstdCompressor(level=1).compress(data) if codec == "zstd" else zlib.compress(data, 1)
    return (codec, packed) if len(packed) < len(data) else ("raw", data)


def decompress(codec: str, data: bytes) -> bytes:
    if codec == "raw":
        return data
    if codec == "lz4":
        return pa.Codec("lz4_raw").decompress(data[LENGTH.size :], decompressed_size=LENGTH.unpack_from(data)[0], asbytes=True)
    return zstandard.ZstdDecompressor().decompress(data) if codec == "zstd" else zlib.decompress(data)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def _alike(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes are equal from a[i] and b[j] on; whole slices are compared, then halves."""
    most = min(len(a) - i, len(b) - j)
    low, step = 0, 64
    while low < most:
        n = min(step, most - low)
        if a[i + low : i + low + n] == b[j + low : j + low + n]:
            low, step = low + n, step * 2
            continue
        while n > 1:
            half = n // 2
            if a[i + low : i + low + half] == b[j + low : j + low + half]:
                low, n = low + half, n - half
            else:
                n = half
        return low
    return most


def delta(base: bytes, target: bytes) -> bytes:
    """Copies from the base and inserted bytes that make the target.

    Entries are: 2 length + 0 and the bytes, or 2 length + 1 and the offset in the base. Blocks of the base are looked up
    at each byte of the target, and a match is made as long as it goes, to both sides.
    """
    blocks = {base[i : i + COPY]: i for i in range(len(base) - COPY, -1, -COPY)}
    out, at, kept = bytearray(), 0, 0
    while at + COPY <= len(target):
        start = blocks.get(target[at : at + COPY])
        if start is None:
            at += 1
            continue
        a, b = at, start
        while a > kept and b > 0 and target[a - 1] == base[b - 1]:
            a, b = a - 1, b - 1
        n = at - a + COPY
        n += _alike(base, b + n, target, a + n)
        if a > kept:
            out += _number(2 * (a - kept)) + target[kept:a]
        out += _number(2 * n + 1) + _number(b)
        at = kept = a + n
    if kept < len(target):
        out += _number(2 * (len(target) - kept)) + target[kept:]
    return bytes(out)


def undelta(base: bytes, coded: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(coded):
        n, at = _read(coded, at)
        if n & 1:
            start, at = _read(coded, at)
            out += base[start : start + n // 2]
        else:
            out += coded[at : at + n // 2]
            at += n // 2
    return bytes(out)


def compressed(data: Column, codec: str = "zstd") -> Column:
    """A struct of codec and bytes."""

    @F.pandas_udf(PACKED)
    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compress(bytes(v), codec) if v is not None else (None, None) for v in values], columns=["codec", "bytes"])

    return of(data)


@F.pandas_udf(T.BinaryType())
def _plain(codecs: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else decompress(c, bytes(v)) for c, v in zip(codecs, values)])


def decompressed(codec: Column, data: Column) -> Column:
    return _plain(codec, data)


@F.pandas_udf(T.BinaryType())
def _delta(bases: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or t is None else delta(bytes(b), bytes(t)) for b, t in zip(bases, targets)])


def delta_encoded(base: Column, target: Column) -> Column:
    return _delta(base, target)


@F.pandas_udf(T.BinaryType())
def _undelta(bases: pd.Series, coded: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or c is None else undelta(bytes(b), bytes(c)) for b, c in zip(bases, coded)])


def delta_decoded(base: Column, coded: Column) -> Column:
    return _undelta(base, coded)
